"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from quern.errors import StorageError

BATCH = 4 << 20  #: bytes of an Arrow batch, of Spark's 64 MB


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset: on one machine a temporary one, set for the session; on a cluster an error, as a folder of one machine would leave the others' rows behind."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise StorageError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/quern-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str = "table", done: Iterable[DataFrame] = ()) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read from there: the plan before it runs once and is not needed again if an executor is lost. Tables in ``done``, made by this function for this one alone, are removed then."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    for before in done:
        dropped(before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, what: str, done: Iterable[DataFrame] = (), **figures: Column) -> tuple[DataFrame, dict]:
    """As :func:`written`, with aggregates of the rows taken while they are written."""
    seen = Observation()
    return written(df.observe(seen, *(c.alias(name) for name, c in figures.items())), what, done), seen.get


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written` that nothing reads any more; other tables stay."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    own = path(shared_folder(spark)).toUri().getPath()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = path(name)
        if folder.getName().startswith("quern-") and folder.getParent().toUri().getPath() == own:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` bytes, unless the session has a setting of its own: a Python worker holds a batch and what it makes of it, so its memory doesn't follow the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m").lower() in ("64m", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Where its scan has fewer partitions than the cluster has cores (a small file of one row group) the rows are dealt out again; a large table is left as it is."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
