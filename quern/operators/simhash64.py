"""64-bit SimHash: the signs of the sums of +-1 over the low 64 bits of the MD5 of every token, and pairs by Hamming distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = 1 << 18  #: tokens that are worked on at a time


@F.arrow_udf(T.LongType())
def _signs(tokens: pa.Array) -> pa.Array:
    n = tokens.value_lengths().fill_null(0).to_numpy()
    out, ends, lo, before = np.zeros(len(n), np.uint64), np.cumsum(n.astype(np.int64)), 0, 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, before + _PART, side="right")))
        words = tokens[lo:hi].flatten().dictionary_encode()  # every different token is hashed once
        digests = b"".join(hashlib.md5(w.encode()).digest()[8:] for w in words.dictionary.to_pylist())
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little")
        at = words.indices.to_numpy()
        for r in np.flatnonzero(n[lo:hi]) + lo:
            on = 2 * bits[at[ends[r] - n[r] - before : ends[r] - before]].sum(axis=0, dtype=np.int64) > n[r]
            out[r] = np.packbits(on, bitorder="little").view(np.uint64)[0]
        lo, before = hi, ends[hi - 1]
    return pa.array(out.view(np.int64))


def simhash64(tokens: Column) -> Column:
    """The fingerprint as a long (two's complement); 0 for no tokens. Every occurrence counts, so it approximates the cosine of the counts."""
    return _signs(tokens)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(prints: DataFrame, most: int = 3, key: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """``(i, j, distance)``, i < j, of all distinct fingerprints at most so many bits apart, each named by its least key; none is missed.

    The bits fall into ``most`` + 1 blocks, one of which two such fingerprints have in common: an equi-join on it,
    in which a pair counts at the first block it has in common.
    """
    blocks = most + 1
    if not 0 <= most < 32:
        raise ValueError(f"the distance has to be from 0 to 31, not {most}")
    ends = [64 * k // blocks for k in range(blocks + 1)]
    first = prints.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("f")).agg(F.min(key).alias("d"))
    parts = [F.shiftrightunsigned("f", a).bitwiseAND(F.lit((1 << (z - a)) - 1)) if z - a < 64 else F.col("f") for a, z in zip(ends, ends[1:])]
    cells = first.select("d", "f", F.posexplode(F.array(*parts)).alias("block", "value"))
    a, b = cells.alias("a"), cells.alias("b")
    meet = (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.d") < F.col("b.d"))
    apart = F.col("a.f").bitwiseXOR(F.col("b.f"))
    masks = [((1 << z) - (1 << a)) - ((1 << 64) if z == 64 else 0) for a, z in zip(ends, ends[1:])]
    first_of = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, k) for k, m in enumerate(masks)))
    meet &= (F.bit_count(apart) <= most) & (first_of == F.col("a.block"))
    return a.join(b, meet).select(F.col("a.d").alias("i"), F.col("b.d").alias("j"), hamming(F.col("a.f"), F.col("b.f")).cast("long").alias("distance"))
