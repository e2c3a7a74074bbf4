"""Sinks: surviving documents as they came, and a sidecar with the figures of a run."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import StorageError
from quern.sources.readers import RECORD


def dedup_rate(before: int, after: int) -> float:
    """Part of the documents that went; 0 where there were none."""
    return (before - after) / before if before else 0.0


def alarm(rate: float, low: float = 0.05, high: float = 0.65) -> str | None:
    """Why a dedup rate is suspicious, if it is."""
    return f"only {rate:.1%} removed: is anything matched?" if rate < low else f"{rate:.1%} removed: is the threshold too low?" if rate > high else None


def write_documents(df: DataFrame, dest: str, output_format: str = "jsonl", order: str | None = "doc_idx", drop: tuple[str, ...] = ("doc_idx",), single_file: bool = False) -> None:
    """Write ``df`` as a directory of part files, in order of a column or (None) as it comes, which saves a shuffle on large data.

    JSON records that ``df`` carries in ``RECORD`` are written as they came, whatever other columns there are. An
    empty result keeps its schema in Parquet. ``single_file`` makes ``dest`` one file, written by one task: for
    outputs that one machine would hold.
    """
    if output_format not in ("jsonl", "parquet"):
        raise StorageError(f"unknown format {output_format!r}")
    rows = df.orderBy(order) if order else df
    rows = rows.select(F.col(RECORD).alias("value")) if output_format == "jsonl" and RECORD in df.columns else rows.drop(*drop, RECORD)
    if single_file:
        rows = rows.coalesce(1)
    folder = f"{dest.rstrip('/')}.parts" if single_file else dest
    out = rows.write.mode("overwrite")
    try:
        if output_format == "parquet":
            out.parquet(folder)
        elif RECORD in df.columns:
            out.text(folder)
        else:
            out.json(folder, ignoreNullFields=False)
        if single_file:
            _as_one_file(df, folder, dest)
    except Exception as e:
        raise StorageError(f"{dest} can't be written: {e}") from e


def _as_one_file(df: DataFrame, folder: str, dest: str) -> None:
    """Give the only part of a folder another name, in place of what is there."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [s.getPath() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("part-")]
    fs.delete(path(dest), True)
    if parts:
        fs.rename(parts[0], path(dest))
    else:
        fs.create(path(dest), True).close()
    fs.delete(path(folder), True)


def stats_path(dest: str) -> str:
    base = dest.rstrip("/")
    return f"{os.path.splitext(base)[0]}_stats.json"


def write_stats(df: DataFrame, dest: str, stats: dict[str, Any]) -> str:
    """The figures as JSON beside ``dest``, on whatever file system that is."""
    path = stats_path(dest)
    write_text(df, path, json.dumps(stats, indent=2, ensure_ascii=False))
    return path


def write_text(df: DataFrame, path: str, text: str) -> None:
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
