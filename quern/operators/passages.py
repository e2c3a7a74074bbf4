"""Passages: long runs of words that repeat, and n-grams shared with a benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 18  #: words that are worked on at a time, or one text


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, by their hashes."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _BASE + words[k : k + n]
    return out ^ (out >> np.uint64(32))


def _least(x: np.ndarray, reach: int, of=np.minimum) -> np.ndarray:
    """The least (or ``of`` another kind) of every ``reach`` values in a row, by doubling."""
    span = 1
    n = len(x) - reach + 1
    while 2 * span <= reach:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[:n], x[reach - span : reach - span + n])


def _picked(hashes: np.ndarray, reach: int, inside: np.ndarray | None = None) -> np.ndarray:
    """The places of the least of every ``reach`` hashes in a row, equal ones all (winnowing): where two texts have ``reach`` hashes in common, they pick the same. Of the stretches of that length only those ``inside`` count."""
    if len(hashes) < reach:
        return np.zeros(0, np.int64)
    least = _least(hashes, reach)
    inside = np.ones(len(least), bool) if inside is None else inside
    # a place is picked if a stretch that holds it has no less: of their least ones, the greatest is its own
    pad = np.zeros(reach - 1, np.uint64)
    best = _least(np.concatenate([pad, np.where(inside, least, 0), pad]), reach, np.maximum)
    covered = np.cumsum(np.concatenate([inside, pad.astype(bool)]).astype(np.int64))
    covered[reach:] -= covered[:-reach].copy()
    return np.flatnonzero((best == hashes) & (covered > 0))


def repeated_passages(docs: DataFrame, words: Column, size: int = 50, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_words)``: the longest stretches of a document that consist of runs of ``size`` words found elsewhere too, in another document or in the same one.

    ``words`` is an array of strings; ``start`` counts words from 0, and runs that overlap make one stretch. First
    every document sends a few hashes of half that length, picked so that two copies of a run pick one in common; of
    documents that share such a hash all runs are counted. Documents shorter than ``size`` and nulls have none;
    a repeated key counts as one document.
    """
    half = max(1, size // 2)
    hashed = docs.select(F.col(key).alias("__d"), F.transform(words, lambda w: F.xxhash64(w)).alias("__w"))

    def hashes(pick: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                every = b.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
                ends, lo, before = np.cumsum(every), 0, 0
                while lo < len(every):
                    hi = max(lo + 1, int(np.searchsorted(ends, before + _PART, side="right")))
                    words = b.column(1)[lo:hi].flatten().to_numpy().view(np.uint64)
                    row = np.repeat(np.arange(lo, hi), every[lo:hi])
                    span = half if pick else size
                    h = _windows(words, span)
                    if pick:
                        reach = size - half + 1
                        at = _picked(h, reach, row[: max(0, len(words) - size + 1)] == row[size - 1 :]) if len(words) >= size else np.zeros(0, np.int64)
                    else:
                        at = np.flatnonzero(row[: len(h)] == row[span - 1 :]) if len(h) else np.zeros(0, np.int64)
                    if len(at):
                        own = row[at]
                        place = at - (ends[own] - every[own] - before)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(place), pa.array(h[at].view(np.int64))], ["__d", "__at", "__h"])
                    lo, before = hi, ends[hi - 1]

        kind = T.StructType([T.StructField("__d", hashed.schema["__d"].dataType), T.StructField("__at", T.LongType()), T.StructField("__h", T.LongType())])
        return run, kind

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__n", F.count("*").over(Window.partitionBy("__h"))).where("__n > 1").drop("__n")  # so that the rows are made once

    some = repeated(hashed.mapInArrow(*hashes(True))).select("__d").distinct()
    found = repeated(hashed.join(some, "__d", "left_semi").mapInArrow(*hashes(False)))
    order = Window.partitionBy("__d").orderBy("__at")
    begins = F.coalesce(F.col("__at") - F.lag("__at").over(order) > size - 1, F.lit(True))
    marked = found.withColumn("__begins", begins).withColumn("__stretch", F.sum(F.col("__begins").cast("int")).over(order))
    spans = marked.groupBy("__d", "__stretch").agg(F.min("__at").alias("start"), (F.max("__at") - F.min("__at") + size).alias("n_words"))
    return spans.select(F.col("__d").alias(key), "start", "n_words")


def shared_ngrams(docs: DataFrame, grams: Column, items: DataFrame, item_grams: Column, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """``(key, item_key, shared, part)``: how many distinct n-grams a document shares with an item, and which part of the item's that is; pairs that share none are left out.

    Items are joined on the hash of the n-gram; Spark broadcasts them where they are small, so that no document is
    shuffled then.
    """
    of_item = items.select(F.col(item_key), F.array_distinct(item_grams).alias("__g")).select(item_key, F.size("__g").alias("__n"), F.explode("__g").alias("__g"))
    of_item = of_item.select(item_key, "__n", F.xxhash64("__g").alias("__h"))
    of_doc = docs.select(F.col(key), F.explode(F.array_distinct(grams)).alias("__g")).select(key, F.xxhash64("__g").alias("__h"))
    return of_doc.join(of_item, "__h").groupBy(key, item_key).agg(F.count("*").alias("shared"), (F.count("*") / F.any_value("__n")).alias("part"))
