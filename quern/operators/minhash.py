"""MinHash signatures as an Arrow column, as plain SQL expressions, and as a stored table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import HashingError
from quern.functions.hashing import EMPTY, coefficients, minhash, reduced, universal_hash


_LOW = np.uint64(0xFFFFFFFF)
_RUN = 1 << 19  #: identities of a batch that are worked on at a time, or one set


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of runs of sets that have at most ``_RUN`` identities, and a thousand sets."""
    ends, lo, before = np.cumsum(size.astype(np.int64)), 0, 0
    while lo < len(size):
        hi = min(lo + 1000, max(lo + 1, int(np.searchsorted(ends, before + _RUN, side="right"))))
        yield lo, hi
        lo, before = hi, ends[hi - 1]


def _mixed(tails: np.ndarray) -> np.ndarray:
    """(sets, bands) hashes of (sets, bands, rows)."""
    out = np.zeros(tails.shape[:2], np.uint64)
    for r in range(tails.shape[2]):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tails[:, :, r]
    return out.view(np.int64)


class MinHasher:
    """A family of ``n`` hash functions drawn from ``seed``."""

    def __init__(self, n: int = 128, seed: int = 42):
        self.n, self.seed = n, seed
        self.family = coefficients(n, seed)

    def transform(self, shingles: Iterable[int]) -> np.ndarray:
        """uint32 signature of one set of 64-bit identities; all ones for an empty set."""
        return self.batch_transform([shingles])[0]

    def batch_transform(self, sets: Iterable[Iterable[int]]) -> np.ndarray:
        """uint32 (sets, n)."""
        parts = [np.array([x % (1 << 64) for x in s], np.uint64) for s in sets]
        bounds = np.cumsum([0, *map(len, parts)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return minhash(flat, bounds, self.family).astype(np.uint32)

    def estimate_jaccard(self, x: np.ndarray, y: np.ndarray) -> float:
        if x.shape != y.shape:
            raise HashingError(f"signatures of shapes {x.shape} and {y.shape}")
        return float(np.mean(x == y))

    def signatures(self, sets: DataFrame, key: str = "doc_idx", shingles: str = "shingles", bands: int = 0) -> DataFrame:
        """``(key, signature)`` of every row; a null array counts as empty.

        With ``bands`` also ``origins``, for each band a hash of the identities that gave its values. Values are
        taken modulo a prime of 32 bits, so two sets of one shingle each are equal by chance among some 100,000
        sets; their origins differ.
        """
        family, n = self.family, self.n

        def lists_of(table: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(table.ravel()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                size = b.column(1).value_lengths().fill_null(0).to_numpy()
                for lo, hi in _runs(size):
                    lists, bounds = b.column(1)[lo:hi], np.concatenate([[0], np.cumsum(size[lo:hi])]).astype(np.int64)
                    out = minhash(np.ascontiguousarray(lists.flatten().to_numpy()), bounds, family, bands > 0)
                    if bands:
                        tails = [lists_of(_mixed((out & _LOW).reshape(hi - lo, bands, n // bands)))]
                        out = (out >> np.uint64(32)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], lists_of(out), *(tails if bands else [])], names)

        kind = T.StructType([sets.schema[key], *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("signature", "origins")[: 1 + (bands > 0)])])
        names = kind.names
        return sets.select(key, shingles).mapInArrow(run, kind)

    def signatures_by_aggregation(self, sets: DataFrame, key: str = "doc_idx", shingles: str = "shingles") -> DataFrame:
        """``(key, signature)`` by exploding the sets and taking minima, all in the JVM: the same values as :meth:`signatures`."""
        a, b = self.family
        rows = sets.select(key, F.explode_outer(shingles).alias("h")).select(key, reduced(F.col("h")).alias("x"))
        least = [F.min(universal_hash(F.col("x"), int(p), int(q))).alias(f"m{i}") for i, (p, q) in enumerate(zip(a, b))]
        return rows.groupBy(key).agg(*least).select(key, F.array(*(F.coalesce(f"m{i}", F.lit(EMPTY)) for i in range(self.n))).alias("signature"))


class SignatureStore:
    """Signatures kept as a Parquet table of ``(doc_idx, signature)``."""

    def __init__(self, spark, path: str, n: int):
        if n < 1:
            raise HashingError(f"a signature has at least one value, not {n}")
        self.spark, self.path, self.n = spark, path, n

    def _checked(self, df: DataFrame) -> DataFrame:
        ok = F.when(F.size("signature") == self.n, F.col("signature")).otherwise(F.raise_error(F.lit(f"a signature hasn't {self.n} values")).cast("array<long>"))
        return df.select(F.col("doc_idx").cast("long"), ok.alias("signature"))

    def write(self, df: DataFrame) -> None:
        self._checked(df).write.mode("overwrite").parquet(self.path)

    def append(self, df: DataFrame) -> None:
        self._checked(df).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema("doc_idx long, signature array<long>").parquet(self.path)

    def get(self, doc_idx: int) -> list[int]:
        """One signature; the filter reaches the scan."""
        row = self.table().where(F.col("doc_idx") == doc_idx).first()
        if row is None:
            raise HashingError(f"there is no signature of document {doc_idx}")
        return list(row["signature"])

    def get_many(self, ids: DataFrame) -> DataFrame:
        return self.table().join(ids.select("doc_idx").distinct(), "doc_idx", "left_semi")

    def __len__(self) -> int:
        return self.table().count()
