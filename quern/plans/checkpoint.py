"""Stages kept as Parquet with a marker and the fingerprint of the run that made them."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.errors import CheckpointError


def fingerprint(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class StageStore:
    """Save, load, ask for, list and delete stages by name; does nothing where ``folder`` is None. The folder may be on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str | None, mark: str = ""):
        self.spark, self.folder, self.mark = spark, folder.rstrip("/") if folder else None, mark

    @property
    def enabled(self) -> bool:
        return self.folder is not None

    def _path(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored_mark(self, name: str) -> str:
        return self.spark.read.text(f"{self.folder}/{name}.mark").first()[0]

    def has(self, name: str) -> bool:
        """Whether the stage was written to its end."""
        if not self.enabled:
            return False
        path, fs = self._path(name, "_SUCCESS")
        mark, _ = self._path(f"{name}.mark", "_SUCCESS")
        return fs.exists(path) and fs.exists(mark)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write the stage and read it from there; the marker comes last, so a run that broke off leaves none."""
        if not self.enabled:
            return df
        self.delete(name)
        df.write.parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(self.mark,)], "mark string").coalesce(1).write.text(f"{self.folder}/{name}.mark")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def load(self, name: str) -> DataFrame:
        if not self.has(name):
            raise CheckpointError(f"stage {name!r} isn't stored" + (f" in {self.folder}" if self.enabled else ""))
        try:
            mark, df = self._stored_mark(name), self.spark.read.parquet(f"{self.folder}/{name}")
        except Exception as e:
            raise CheckpointError(f"stage {name!r} can't be read: {e}") from e
        if mark != self.mark:
            raise CheckpointError(f"stage {name!r} was stored by a run with other settings or another source")
        return df

    def delete(self, name: str) -> bool:
        """Whether there was anything to delete."""
        if not self.enabled:
            return False
        gone = False
        for n in (f"{name}.mark", name):
            path, fs = self._path(n)
            gone |= fs.delete(path, True)
        return gone

    def list(self) -> list[str]:
        if not self.enabled:
            return []
        path, fs = self._path()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if not n.endswith(".mark") and self.has(n))
