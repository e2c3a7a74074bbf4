"""The deduplication pipeline: ten stages, each a function from DataFrames to a DataFrame, and the runs made of them."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.config import PipelineConfig
from quern.functions import text as T
from quern.operators import clusters as C
from quern.operators import lsh
from quern.operators.minhash import MinHasher
from quern.plans.checkpoint import StageStore, fingerprint
from quern.sources.readers import ID, content_mark, read_documents
from quern.sources.writers import alarm, dedup_rate, write_documents, write_stats
from quern.storage import dropped as remove
from quern.storage import small_batches, written

_LOG = logging.getLogger(__name__)


class DedupPipeline:
    """MinHash and LSH over a corpus. Survivors are written as they came; text is normalized only to be compared."""

    def __init__(self, config: PipelineConfig | None = None, spark: SparkSession | None = None):
        self.config = config or PipelineConfig()
        self.spark = spark or SparkSession.builder.getOrCreate()
        small_batches(self.spark)
        self.hasher = MinHasher(self.config.num_hash_functions, self.config.random_seed)
        self.runtime_per_stage: dict[str, float] = {}
        self.figures: dict[str, int] = {}

    @contextmanager
    def _timed(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.runtime_per_stage[stage] = self.runtime_per_stage.get(stage, 0.0) + time.perf_counter() - began

    # 1
    def stream_documents(self, source: Any) -> DataFrame:
        """``doc_idx, id, text`` and the source's other columns."""
        return read_documents(self.spark, source, self.config.text_field, self.config.id_field)

    # 2
    def normalize_batch(self, docs: DataFrame) -> DataFrame:
        """Adds ``norm_text``."""
        return docs.withColumn("norm_text", T.normalize(F.col("text")))

    # 3
    def shingle_batch(self, docs: DataFrame) -> DataFrame:
        """``doc_idx, shingles`` from norm_text."""
        c = self.config
        return docs.select("doc_idx", T.shingles(F.col("norm_text"), c.shingle_mode, c.shingle_size, c.cjk_ratio_threshold, c.random_seed).alias("shingles"))

    # 4
    def compute_signatures(self, sets: DataFrame, origins: bool = True) -> DataFrame:
        """``doc_idx, signature`` and ``origins``, which tell apart signatures that are equal by chance; documents without shingles have one signature in common."""
        return self.hasher.signatures(sets, bands=self.config.lsh_bands if origins else 0)

    # 5
    def build_bucket_index(self, signatures: DataFrame) -> DataFrame:
        """``doc_idx, band, key``."""
        return lsh.band_keys(signatures, self.config.lsh_bands, self.config.lsh_rows)

    # 6
    def enumerate_candidate_pairs(self, keys: DataFrame) -> DataFrame:
        return lsh.candidate_pairs(keys)

    # 7
    def verify_pairs(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        return lsh.verified(pairs, signatures, self.config.jaccard_threshold).select("i", "j")

    # 8
    def cluster_duplicates(self, pairs: DataFrame) -> DataFrame:
        """``cluster_id, doc_idx``."""
        return C.duplicate_clusters(pairs, self.config.min_cluster_size)

    # 9
    def select_representatives(self, clusters: DataFrame, docs: DataFrame) -> DataFrame:
        """``cluster_id, doc_idx`` of the documents that stand for their clusters; the longest is so by norm_text."""
        lengths = docs.select("doc_idx", F.length("norm_text").alias("length")) if self.config.representative_strategy == "longest" else None
        return C.representatives(clusters, lengths, self.config.representative_strategy, self.config.random_seed)

    # 10
    def write_deduplicated(self, docs: DataFrame, dropped: DataFrame, dest: str, histogram: dict[int, int] | None = None, before: int | None = None) -> dict[str, Any]:
        """Write the rows of ``docs`` that aren't dropped, under the source's names; returns the run's figures, written beside them too."""
        c = self.config
        with self._timed("write_deduplicated"):
            kept = docs.drop("norm_text").join(dropped.select("doc_idx"), "doc_idx", "left_anti")
            names = {ID: c.id_field, "text": c.text_field}  # an id that the source hadn't isn't written
            kept = kept.select("doc_idx", *(F.col(f"`{x}`").alias(names.get(x, x)) for x in sorted(kept.columns, key=lambda x: x != ID) if x not in ("doc_idx", "id")))
            write_documents(kept, dest, c.output_format, single_file=c.single_file)
        before = docs.count() if before is None else before
        after = before - dropped.count()
        stats = {
            "input_count": before,
            "output_count": after,
            "dedup_rate": dedup_rate(before, after),
            "cluster_size_histogram": {str(k): n for k, n in sorted((histogram or {}).items())},
            "alarm": alarm(dedup_rate(before, after)) if before else None,
            **self.figures,
            "runtime_per_stage": dict(self.runtime_per_stage),
            "config": c.to_dict(),
        }
        if stats["alarm"]:
            _LOG.warning("%s: %s", dest, stats["alarm"])
        write_stats(docs, dest, stats)
        return stats

    def duplicate_edges(self, signatures: DataFrame) -> DataFrame:
        """``(i, j)`` whose components are the clusters. Documents of one signature are joined first; of the distinct signatures either all candidate pairs are verified (high_precision_mode) or each bucket member is linked to the bucket's least, which connects the same documents with fewer edges."""
        distinct, copies = lsh.collapsed(signatures)
        distinct = written(distinct, "distinct")
        keys = self.build_bucket_index(distinct)
        if self.config.high_precision_mode:
            return copies.union(self.verify_pairs(self.enumerate_candidate_pairs(keys), distinct))
        return copies.union(lsh.connecting_edges(keys))

    def detect_clusters(self, source: Any) -> tuple[DataFrame, int]:
        """Clusters and the number of documents, without output."""
        docs = self.normalize_batch(self.stream_documents(source))
        signatures = written(self.compute_signatures(self.shingle_batch(docs)), "signatures")
        return written(self.cluster_duplicates(self.duplicate_edges(signatures)), "clusters"), signatures.count()

    def run(self, source: Any, dest: str, resume: bool = False) -> dict[str, Any]:
        """Deduplicate ``source`` into ``dest``; with a checkpoint_dir every stage is stored, with ``resume`` stored stages are taken up. A stage of other settings or of a source with another content raises CheckpointError.

        The figures of a run that made these stages itself include the total of shingles and the documents cut by
        character for being CJK.
        """
        self.runtime_per_stage, self.figures = {}, {}
        c = self.config
        settings = {k: v for k, v in c.to_dict().items() if k not in ("checkpoint_dir", "batch_size", "use_numba", "output_format", "single_file")}
        told = content_mark(self.spark, source) if c.checkpoint_dir else ""
        store = StageStore(self.spark, c.checkpoint_dir, fingerprint(told, settings))
        made, temporary = set(), []

        def stage(name: str, make) -> DataFrame:
            with self._timed(name):
                if resume and store.has(name):
                    return store.load(name)
                made.add(name)
                df = make()
                if store.enabled:
                    return store.save(name, df)
                temporary.append(written(df, name))
                return temporary[-1]

        cjk, shingles = Observation(), Observation()
        by_character = T.is_cjk(F.col("norm_text"), c.cjk_ratio_threshold) if c.shingle_mode == "word" else F.lit(False)
        docs = stage("documents", lambda: self.normalize_batch(self.stream_documents(source)).observe(cjk, F.count_if(by_character).alias("cjk_documents")))
        signatures = stage("signatures", lambda: self.compute_signatures(self.shingle_batch(docs).observe(shingles, F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("total_shingles"))))
        if "documents" in made:
            self.figures["cjk_documents"] = cjk.get["cjk_documents"]
        if "signatures" in made:
            self.figures["total_shingles"] = shingles.get["total_shingles"]
        edges = stage("candidate_pairs", lambda: self.duplicate_edges(signatures))
        clusters = stage("clusters", lambda: self.cluster_duplicates(edges))
        dropped = stage("dropped", lambda: C.dropped_ids(clusters, self.select_representatives(clusters, docs)))
        histogram = {r["size"]: r["n_clusters"] for r in C.size_histogram(clusters).collect()}
        stats = self.write_deduplicated(docs, dropped, dest, histogram, signatures.count())
        for table in temporary:
            remove(table)
        return stats
