"""Locality-sensitive hashing: band keys, buckets, candidate pairs, verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import ConfigError
from quern.functions.hashing import estimate_jaccard


def band_keys(signatures: DataFrame, bands: int, rows: int, raw: bool = False) -> DataFrame:
    """``(doc_idx, band, key)``: a 64-bit hash of the band's values, the band mixed in; ``raw`` keys are the values themselves, free of collisions but heavier to shuffle. A signature of another width is an error. Where there is a column ``origins`` (of :meth:`MinHasher.signatures`), bands agree only if theirs do."""
    if bands < 1 or rows < 1:
        raise ConfigError("there has to be at least one band of at least one row")
    part = lambda i: F.slice("signature", i * rows + 1, rows)
    told = "origins" in signatures.columns
    whole = lambda i: F.concat(part(i), F.array(F.get("origins", i))) if told else part(i)
    each = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: whole(i) if raw else F.xxhash64(i, whole(i)))
    fits = F.when(F.size("signature") == bands * rows, each).otherwise(F.raise_error(F.lit(f"a signature hasn't {bands} x {rows} values")).cast(f"array<{'array<long>' if raw else 'long'}>"))
    return signatures.select("doc_idx", F.posexplode(fits).alias("band", "key"))


def buckets(keys: DataFrame) -> DataFrame:
    """``(band, key, size, members)`` of the buckets with two documents or more."""
    return keys.groupBy("band", "key").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("doc_idx")).alias("members")).where("size > 1")


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """``(i, j)``, i < j, once each: all pairs that share a bucket. The join is an equi-join on the bucket, so Spark splits skewed ones at run time."""
    left, right = keys.alias("l"), keys.alias("r")
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_idx") < F.col("r.doc_idx"))
    return left.join(right, same).select(F.col("l.doc_idx").alias("i"), F.col("r.doc_idx").alias("j")).distinct()


def encode_pair(i: Column | int, j: Column | int) -> Column | int:
    """One 64-bit key of a pair of indices from 0 to 2^32 - 1 (as two's complement in a column)."""
    if isinstance(i, Column) or isinstance(j, Column):
        i, j = (x if isinstance(x, Column) else F.lit(x) for x in (i, j))
        return F.shiftleft(i.cast("long"), 32).bitwiseOR(j.cast("long"))
    return i << 32 | j


class BucketIndex:
    """Buckets of document indices on the driver, for what fits there; :func:`buckets` does the same for a table of keys."""

    def __init__(self) -> None:
        self._members: dict[int, list[int]] = {}

    @classmethod
    def from_keys(cls, keys: DataFrame) -> BucketIndex:
        """The buckets of two or more of a small table of keys, by ``(band, key)``."""
        out = cls()
        for row in buckets(keys).toLocalIterator():
            out.add_bucket((row["band"], row["key"]), row["members"])
        return out

    def add(self, bucket_key: int, doc_index: int) -> None:
        self._members.setdefault(bucket_key, []).append(doc_index)

    def add_bucket(self, bucket_key: int, doc_indices: Iterable[int]) -> None:
        self._members.setdefault(bucket_key, []).extend(doc_indices)

    def candidate_buckets(self) -> Iterator[list[int]]:
        """The members of every bucket that holds two or more."""
        return (m for m in self._members.values() if len(m) > 1)

    def as_dict(self) -> dict[int, list[int]]:
        return self._members

    def __len__(self) -> int:
        return len(self._members)


def cross_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(i, j)``: documents of two corpora that share a bucket."""
    return left.select(F.col("doc_idx").alias("i"), "band", "key").join(right.select(F.col("doc_idx").alias("j"), "band", "key"), ["band", "key"]).select("i", "j").distinct()


def connecting_edges(keys: DataFrame) -> DataFrame:
    """``(i, j)`` that connect the same documents as :func:`candidate_pairs`, but one per member and bucket: each is linked to the bucket's least."""
    least = keys.groupBy("band", "key").agg(F.min("doc_idx").alias("i"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(least, ["band", "key"]).where("doc_idx > i").select("i", F.col("doc_idx").alias("j")).distinct()


def collapsed(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per distinct signature (with its origins, if they are there), under its least doc_idx, and ``(i, j)`` edges from it to the documents that share it. Equal signatures share every band, so this changes no cluster and takes the quadratic cost out of copies."""
    all_of = [c for c in ("signature", "origins") if c in signatures.columns]
    mark = F.xxhash64(*all_of)
    first = signatures.groupBy(*all_of).agg(F.min("doc_idx").alias("doc_idx"), F.count("*").alias("n"))
    many = first.where("n > 1").select(F.col("doc_idx").alias("i"), *all_of, mark.alias("mark"))
    edges = signatures.withColumn("mark", mark).join(many, ["mark", *all_of]).where("doc_idx > i").select("i", F.col("doc_idx").alias("j"))
    return first.select("doc_idx", *all_of), edges


def with_estimates(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs with the estimated Jaccard similarity of their signatures."""
    a = signatures.select(F.col("doc_idx").alias("i"), F.col("signature").alias("__a"))
    b = signatures.select(F.col("doc_idx").alias("j"), F.col("signature").alias("__b"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", estimate_jaccard(F.col("__a"), F.col("__b")).alias("estimate"))


def verified(pairs: DataFrame, signatures: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate reaches the threshold."""
    return with_estimates(pairs, signatures).where(F.col("estimate") >= threshold)
