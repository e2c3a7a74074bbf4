"""Five stages from raw documents to tokens.

Each stage takes what its predecessor kept, with the columns of documents; the last returns tokens. Models and
counts of a stage come from the documents it is given. Columns beyond those of documents, whatever their names,
pass through all stages but the last; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe import encode
from quern.llm.decontaminate import without_contaminated
from quern.llm.langid import in_known_language
from quern.llm.quality import of_quality
from quern.llm.simhash import without_near_duplicates
from quern.storage import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the calibrated probability of good quality go. Texts that are null, empty or white space go; a null or repeated doc_id doesn't matter, equal texts are judged alike; where no network can be fitted every text with a token stays."""
    return of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in another language than they declare, or without a letter (null and empty texts too), go. A null language, and a text too short to tell, is no reason; ties between languages go to the first by name; equal texts that declare the same are judged alike."""
    return in_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, that of the least doc_id. Rows with a null doc_id stay; rows that repeat a doc_id are judged each by its text, of those of one class the least text stays; texts without words are alike if they are equal."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, go. Null and empty texts stay, null items count for nothing; ids play no part."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document left, and that decoding gives it back; nulls for a null text, no tokens for an empty one."""
    return encode(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokenize", tokenize)]
ORACLE_SQL = None  # the trained network, the fingerprints and byte merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, round_trip)`` of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, [docs])  # what the stage before wrote is removed
    return STAGES[-1][1](spark, docs, sf_dir)
