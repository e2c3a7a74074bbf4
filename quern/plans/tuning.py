"""Grid search over shingle size, banding and threshold, with each costly step done once."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import PipelineConfig
from quern.functions.hashing import factorizations
from quern.operators import clusters as C
from quern.operators import lsh
from quern.operators.evaluate import cluster_confusion
from quern.plans.pipeline import DedupPipeline
from quern.storage import written


def evaluate(pipeline: DedupPipeline, source: Any, truth: DataFrame) -> dict[str, float]:
    """Precision, recall and F1 of the pairs within clusters."""
    clusters, _ = pipeline.detect_clusters(source)
    return cluster_confusion(clusters, truth).first().asDict()


def tune(source: Any, truth: DataFrame, base: PipelineConfig, spark, sizes: Iterable[int] = (3, 5), thresholds: Iterable[float] = (0.7, 0.8, 0.9)) -> list[dict[str, Any]]:
    """Results of every combination, best F1 first (ties in grid order). Signatures are made once per shingle size, pair estimates once per banding."""
    results = []
    docs = None
    for k in sizes:
        p = DedupPipeline(base.replace(shingle_size=k), spark)
        docs = written(p.normalize_batch(p.stream_documents(source)), "documents") if docs is None else docs
        signatures = written(p.compute_signatures(p.shingle_batch(docs), origins=False), "signatures")
        for bands, rows in factorizations(base.num_hash_functions):
            keys = lsh.band_keys(signatures, bands, rows)
            if base.high_precision_mode:
                pairs = written(lsh.with_estimates(lsh.candidate_pairs(keys), signatures), "pairs")
                scores = {t: cluster_confusion(C.duplicate_clusters(pairs.where(F.col("estimate") >= t).select("i", "j"), base.min_cluster_size), truth).first() for t in thresholds}
            else:  # the threshold has no part in it then
                found = cluster_confusion(C.duplicate_clusters(lsh.connecting_edges(keys), base.min_cluster_size), truth).first()
                scores = dict.fromkeys(thresholds, found)
            results += [{"shingle_size": k, "lsh_bands": bands, "lsh_rows": rows, "jaccard_threshold": t, **r.asDict()} for t, r in scores.items()]
    return sorted(results, key=lambda r: -r["f1"])
