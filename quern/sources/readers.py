"""Document sources: lists, JSON lines (also gzipped), Parquet, globs and DataFrames.

A source becomes ``doc_idx, id, text`` and every other column that it has.
Records whose text is missing or not a string are dropped, as are lines that
are not JSON objects. What a record was is kept as it came: a JSON line, or a
mapping as JSON, in ``RECORD``; an id that is not a string in ``ID``.
"""

from __future__ import annotations

import dataclasses
import glob as _glob
import hashlib
import json
import os
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import StorageError
from quern.sources.tables import with_index

RECORD, ID = "__record", "__id"  #: columns of the record as JSON, and of the source's own ids


@dataclasses.dataclass(slots=True)
class Document:
    """One document on the driver: a row that :func:`read_documents` gives, with its other columns as metadata."""

    id: str
    text: str
    metadata: dict[str, Any] = dataclasses.field(default_factory=dict)

    @classmethod
    def from_row(cls, row: Row) -> Document:
        values = row.asDict(recursive=True)
        record = values.pop(RECORD, None)
        for name in ("doc_idx", ID):
            values.pop(name, None)
        own, text = values.pop("id"), values.pop("text")
        return cls(own, text, json.loads(record) if record is not None else values)


JSON_LINES, PARQUET = (".jsonl", ".json", ".ndjson"), (".parquet", ".pq")


def _kind(path: str) -> str:
    name = path.rstrip("/")
    if name.endswith(".gz"):
        name = name[:-3]
    suffix = os.path.splitext(name)[1]
    if suffix in JSON_LINES:
        return "json"
    if suffix in PARQUET:
        return "parquet"
    raise StorageError(f"{path}: neither JSON lines ({', '.join(JSON_LINES)}, also with .gz) nor Parquet ({', '.join(PARQUET)})")


def _from_list(spark: SparkSession, records: Iterable[Mapping[str, Any]], text_field: str) -> DataFrame:
    rows = [dict(r) for r in records if isinstance(r, Mapping) and isinstance(r.get(text_field), str)]
    names = list(dict.fromkeys(k for r in rows for k in r)) or [text_field]
    kinds = {}
    for k in names:
        seen = {type(r[k]) for r in rows if r.get(k) is not None}
        if k == text_field or len(seen) != 1 or seen & {dict, list, tuple}:
            kinds[k] = T.StringType()
        else:
            kinds[k] = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}.get(seen.pop(), T.StringType())
    schema = T.StructType([T.StructField("__n", T.LongType()), T.StructField(RECORD, T.StringType()), *(T.StructField(k, kinds[k]) for k in names)])

    def cell(value: Any, kind: T.DataType) -> Any:
        if value is None or not isinstance(kind, T.StringType) or isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False, default=str)

    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False, default=str), *(cell(r.get(k), kinds[k]) for k in names)) for i, r in enumerate(rows)], schema)


def _from_json(spark: SparkSession, paths: list[str], text_field: str) -> DataFrame:
    schema = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(paths).schema
    fields = [f for f in schema.fields if f.name not in ("__bad", text_field)]
    wanted = T.StructType([*fields, T.StructField(text_field, T.StringType())])
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__n"))
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$['{text_field}']", "variant"))
    good = lines.where(F.schema_of_variant(parsed).startswith("OBJECT") & (kind == "STRING"))
    return good.withColumn("__r", F.from_json("value", wanted)).select("__file", "__start", "__n", F.col("value").alias(RECORD), "__r.*")


def read_documents(spark: SparkSession, source: Any, text_field: str = "text", id_field: str = "id") -> DataFrame:
    """``doc_idx, id, text`` and the other columns of a source; ``RECORD`` and ``ID`` where it has them.

    ``source``: a DataFrame, a list of mappings, a path (a directory of part files too) or a glob, with files taken in
    sorted order. ``doc_idx`` counts the valid records from 0; a DataFrame is ordered by ``id_field`` if it has
    that column, else as it stands. A null or missing id becomes the index as a string.
    """
    if isinstance(source, DataFrame):
        rows, order = source, ([F.col(f"`{id_field}`")] if id_field in source.columns else [])
    elif isinstance(source, (list, tuple)):
        rows, order = _from_list(spark, source, text_field), ["__n"]
    elif isinstance(source, str):
        if any(c in source for c in "*?["):
            paths = sorted(_glob.glob(source, recursive=True)) if "://" not in source else [source]
            if not paths:
                raise StorageError(f"nothing matches {source}")
        elif "://" in source or os.path.exists(source):
            paths = [source]
        else:
            raise StorageError(f"{source} isn't here; data sets of a hub can't be loaded without a network")
        kinds = {_kind(p) for p in paths}
        if len(kinds) > 1:
            raise StorageError(f"{source} mixes formats")
        if kinds == {"json"}:
            rows, order = _from_json(spark, paths, text_field), ["__file", "__start", "__n"]
        else:
            read = spark.read.parquet(*paths)
            rows = read.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.row_index")})
            order = ["__file", "__start"]
    else:
        raise StorageError(f"can't read from {type(source).__name__}")
    if text_field not in rows.columns:
        raise StorageError(f"there is no column {text_field!r}")
    if not isinstance(rows.schema[text_field].dataType, T.StringType):
        rows = rows.where(F.lit(False)).withColumn(text_field, F.lit(None).cast("string"))
    rows = with_index(rows.where(F.col(f"`{text_field}`").isNotNull()), *order, name="__idx")
    own = F.col(f"`{id_field}`").cast("string") if id_field in rows.columns else F.lit(None).cast("string")
    rest = [c for c in rows.columns if c not in ("__idx", "__n", "__file", "__start", RECORD) and c not in ("doc_idx", "id", "text", id_field, text_field)]
    kept = [F.col(RECORD)] if RECORD in rows.columns else []
    if id_field in rows.columns:
        kept.append(F.col(f"`{id_field}`").alias(ID))
    return rows.select(F.col("__idx").alias("doc_idx"), F.coalesce(own, F.col("__idx").cast("string")).alias("id"), F.col(f"`{text_field}`").alias("text"), *(F.col(f"`{c}`") for c in rest), *kept)


def content_mark(spark: SparkSession, source: Any) -> str:
    """A mark that changes with what a source holds: of a path the files with sizes and times, of records or a DataFrame (one pass over its rows) the content."""
    if isinstance(source, DataFrame):
        row = source.select(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        return f"{row[0]} rows, {row[1]}"
    if not isinstance(source, str):
        return hashlib.sha256(json.dumps(list(source), sort_keys=True, default=str).encode()).hexdigest()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, open_ = [], list(fs.globStatus(path) or [])
    while open_:
        status = open_.pop()
        if status.isDirectory():
            open_ += fs.listStatus(status.getPath())
        else:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return json.dumps(sorted(found))
