"""``python -m quern.cli``: deduplicate, evaluate, tune, benchmark, inspect."""

from __future__ import annotations

import argparse
import json
import sys
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.config import PipelineConfig
from quern.errors import DedupError, EvaluationError
from quern.operators.evaluate import canonical_pairs
from quern.operators.similarity import corpus_statistics
from quern.plans.pipeline import DedupPipeline
from quern.plans.tuning import evaluate, tune
from quern.sources.readers import read_documents


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """True pairs from a JSON file: a list of pairs, or an object that holds one as ``pairs``."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError) as e:
        raise EvaluationError(f"{path} can't be read: {e}") from e
    pairs = data.get("pairs") if isinstance(data, dict) else data
    if not isinstance(pairs, list) or not all(isinstance(p, list) and len(p) == 2 for p in pairs):
        raise EvaluationError(f"{path} doesn't hold pairs")
    return canonical_pairs(spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "i long, j long"))


def inspect(spark: SparkSession, source: Any, text_field: str = "text", id_field: str = "id") -> dict[str, Any]:
    row = corpus_statistics(read_documents(spark, source, text_field, id_field)).first().asDict()
    if not row["documents"]:
        raise EvaluationError("there are no documents")
    return row


def benchmark(spark: SparkSession, source: Any, config: PipelineConfig, n_docs: int) -> dict[str, float]:
    """Documents per second from text to signatures, over the first ``n_docs``."""
    p = DedupPipeline(config, spark)
    docs = p.stream_documents(source).where(f"doc_idx < {int(n_docs)}")
    n = docs.count()
    began = time.perf_counter()
    p.compute_signatures(p.shingle_batch(p.normalize_batch(docs))).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"documents": n, "seconds": took, "documents_per_second": n / took if took else 0.0}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("deduplicate", "evaluate", "tune", "benchmark", "inspect"):
        c = commands.add_parser(name)
        c.add_argument("source")
        c.add_argument("--config", help="JSON file of settings")
        c.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="one setting; VALUE is JSON or else text")
        if name == "deduplicate":
            c.add_argument("dest")
            c.add_argument("--resume", action="store_true")
        elif name in ("evaluate", "tune"):
            c.add_argument("truth", help="JSON file of true pairs")
        elif name == "benchmark":
            c.add_argument("--n-docs", type=int, default=10_000)
        if name == "tune":
            c.add_argument("--output", help="file for all results")
    a = parser.parse_args(argv)
    overrides: dict[str, Any] = {}
    for item in a.set:
        key, _, value = item.partition("=")
        try:
            overrides[key] = json.loads(value)
        except ValueError:
            overrides[key] = value
    try:
        config = PipelineConfig.from_json(a.config, **overrides) if a.config else PipelineConfig.from_env(**overrides)
        spark = spark or SparkSession.builder.getOrCreate()
        if a.command == "deduplicate":
            out: Any = DedupPipeline(config, spark).run(a.source, a.dest, a.resume)
        elif a.command == "evaluate":
            out = evaluate(DedupPipeline(config, spark), a.source, read_truth(spark, a.truth))
        elif a.command == "tune":
            out = tune(a.source, read_truth(spark, a.truth), config, spark)
            if a.output:
                with open(a.output, "w", encoding="utf-8") as f:
                    json.dump(out, f, indent=2)
            out = out[:10]
        elif a.command == "benchmark":
            out = benchmark(spark, a.source, config, a.n_docs)
        else:
            out = inspect(spark, a.source, config.text_field, config.id_field)
    except DedupError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
