"""Deduplication of a stream against all that came before, by the band keys of what was kept.

Every micro-batch is deduplicated within itself and against stored keys; what
stays is appended, and so are its keys. Both are written under the batch's
number, so a batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.config import PipelineConfig
from quern.operators import lsh
from quern.operators.clusters import dropped_ids, duplicate_clusters, representatives
from quern.plans.pipeline import DedupPipeline
from quern.sources.tables import with_index
from quern.storage import dropped, written

KEYS = "band int, key long, batch long"
BROADCAST_KEYS = 1_000_000  #: keys of a batch (16 MB) that are broadcast


def keep_new(batch: DataFrame, known: DataFrame, pipeline: DedupPipeline) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows of a batch that repeat neither each other nor anything known by its band keys, their keys ``(band, key)``, and the tables to remove when both are stored.

    Of what is known only the keys are scanned: those of a batch of up to ``BROADCAST_KEYS`` keys are broadcast, so
    that nothing of the state is shuffled.
    """
    docs = written(pipeline.normalize_batch(with_index(batch.where(F.col("text").isNotNull()), name="doc_idx")), "batch")
    signatures = written(pipeline.compute_signatures(pipeline.shingle_batch(docs)), "signatures")
    clusters = duplicate_clusters(pipeline.duplicate_edges(signatures), pipeline.config.min_cluster_size)
    repeated = dropped_ids(clusters, representatives(clusters, strategy="first"))
    keys = pipeline.build_bucket_index(signatures)
    own = keys.select("band", "key").distinct()
    few = signatures.count() * pipeline.config.lsh_bands <= BROADCAST_KEYS
    hit = known.join(F.broadcast(own) if few else own, ["band", "key"], "left_semi").distinct()
    seen = keys.join(hit, ["band", "key"], "left_semi").select("doc_idx")
    gone = written(repeated.union(seen).distinct(), "gone")
    return docs.drop("norm_text").join(gone, "doc_idx", "left_anti").drop("doc_idx"), keys.join(gone, "doc_idx", "left_anti").select("band", "key"), [docs, signatures, gone]


def deduplicate_stream(stream: DataFrame, dest: str, state: str, checkpoint: str, config: PipelineConfig | None = None, **trigger) -> StreamingQuery:
    """Start a query that appends the new documents of ``stream`` (with a column text) to ``dest`` as Parquet; ``state`` holds the keys. ``trigger`` as for ``DataStreamWriter.trigger``."""
    spark = stream.sparkSession
    pipeline = DedupPipeline(config, spark)

    def each(batch: DataFrame, number: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        known = spark.read.schema(KEYS).parquet(state) if there else spark.createDataFrame([], KEYS)
        kept, keys, tables = keep_new(batch, known.where(F.col("batch") < number).select("band", "key"), pipeline)
        kept.write.mode("overwrite").parquet(f"{dest}/batch={number}")
        keys.distinct().write.mode("overwrite").parquet(f"{state}/batch={number}")
        for t in tables:
            dropped(t)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
