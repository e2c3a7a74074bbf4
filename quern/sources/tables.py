"""Rows in a defined order: a dense index that is computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import written

_ROWS = 33  # bits of the row within a partition


def with_index(df: DataFrame, *order: Column | str, name: str = "doc_idx") -> DataFrame:
    """``df`` with its 0-based position in the given order (as it stands where none is given), dense and stable.

    The rows are range-sorted, written once to the shared folder and numbered by the sizes of the sorted
    partitions, so that no step gathers them in one place.
    """
    there = df.orderBy(*order) if order else df
    numbered = written(there.withColumn("__row", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("__row", _ROWS)
    sizes = sorted(numbered.groupBy(part.alias("part")).agg((F.max(F.col("__row").bitwiseAND(F.lit((1 << _ROWS) - 1))) + 1).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:  # one row per partition
        starts.append((p, before))
        before += n
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "__part long, __offset long"))
    joined = numbered.withColumn("__part", part).join(table, "__part", "left")
    return joined.select((F.col("__offset") + F.col("__row").bitwiseAND(F.lit((1 << _ROWS) - 1))).alias(name), *(F.col(f"`{c}`") for c in df.columns if c != name))
