"""Hash families, MinHash values and the arithmetic of banding."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import ConfigError, HashingError

PRIME = (1 << 32) - 5
EMPTY = (1 << 32) - 1  #: every value of the signature of an empty set
_FOLD = (1 << 64) % PRIME  # 25


def coefficients(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers in [1, P) and offsets in [0, P), uint64, drawn in this order from one seeded generator."""
    if n < 1:
        raise HashingError(f"there has to be at least one hash function, not {n}")
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n, dtype=np.uint64), rng.integers(0, PRIME, n, dtype=np.uint64)


def reduced(h: Column) -> Column:
    """A 64-bit identity, read as unsigned, modulo P."""
    return F.pmod(F.pmod(h, F.lit(PRIME)) + F.when(h < 0, F.lit(_FOLD)).otherwise(F.lit(0)), F.lit(PRIME))


def universal_hash(x: Column, a: int, b: int) -> Column:
    """(a x + b) mod P for x below P, in steps that stay within 63 bits."""
    return ((F.lit(a >> 16) * x) % PRIME * 65_536 + F.lit(a & 65_535) * x + F.lit(b)) % PRIME


def hash_value(x: int, i: int, family: tuple[np.ndarray, np.ndarray]) -> int:
    """Function i of a family at one identity."""
    a, b = family
    if not 0 <= i < len(a):
        raise HashingError(f"there is no hash function {i} among {len(a)}")
    return (int(a[i]) * (x % (1 << 64) % PRIME) + int(b[i])) % PRIME


_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _mod(y: np.ndarray) -> np.ndarray:
    """y mod P for uint64, in place, by folding the upper half twice."""
    for _ in range(2):
        high = y >> _HALF
        high *= np.uint64(5)
        y &= _LOW
        y += high
    if y.size and y.max() >= PRIME:  # rarely
        np.subtract(y, np.uint64(PRIME), out=y, where=y >= np.uint64(PRIME))
    return y


_BLOCK = 1 << 19  #: identities that are looked at together
_TABLE = 1 << 25  #: bytes of their hash values, of as many functions at a time as that allows
_ROWS = 1024  #: identities whose hashes fit the processor's cache


def _hashed(x: np.ndarray, a: np.ndarray, b: np.ndarray, tail: np.ndarray | None) -> np.ndarray:
    """(identities, functions): hash values, above the tail where one is wanted."""
    out = np.empty((len(x), len(a)), np.uint32 if tail is None else np.uint64)
    for lo in range(0, len(x), _ROWS):
        y = x[lo : lo + _ROWS, None] * a
        y += b
        _mod(y)
        if tail is not None:
            y <<= _HALF
            y |= tail[lo : lo + _ROWS, None]
        out[lo : lo + _ROWS] = y
    return out


def minhash(values: np.ndarray, bounds: np.ndarray, family: tuple[np.ndarray, np.ndarray], tails: bool = False) -> np.ndarray:
    """(sets, functions) signatures of many sets laid end to end in ``values`` (int64 or uint64); ``bounds`` has one more entry than sets.

    Every different identity of a block is hashed once, however many sets have it. With ``tails`` each value
    (uint64) has it in the upper half and in the lower the upper half of the identity that gave it: that tells
    identities apart that are equal modulo P.
    """
    a, b = family
    size = np.diff(bounds)
    out = np.full((len(size), len(a)), EMPTY << 32 if tails else EMPTY, np.uint64 if tails else np.int64)
    full = np.flatnonzero(size)
    lo = 0
    while lo < len(full):  # blocks of whole sets, a larger set alone
        hi = max(lo + 1, int(np.searchsorted(bounds[full + 1], bounds[full[lo]] + _BLOCK, side="right")))
        part = full[lo:hi]
        start = bounds[part[0]]
        own = values[start : bounds[part[-1] + 1]].view(np.uint64)
        u, at = np.unique(own, return_inverse=True)
        if 2 * len(u) > len(own):
            _each(own, bounds[part] - start, part, family, tails, out)
            lo = hi
            continue
        x, tail = _mod(u.copy()), u >> _HALF if tails else None
        group = max(1, _TABLE // (len(x) * (8 if tails else 4)))
        for g in range(0, len(a), group):
            h, some = _hashed(x, a[g : g + group], b[g : g + group], tail), slice(g, g + group)
            for r in part:
                mine = at[bounds[r] - start : bounds[r + 1] - start]
                out[r, some] = np.minimum.reduce([h[mine[k : k + _ROWS]].min(axis=0) for k in range(0, len(mine), _ROWS)])
        lo = hi
    return out


_FEW = 1 << 15  #: identities, in whole sets, of which one function after the other is taken in the processor's cache


def _each(values: np.ndarray, starts: np.ndarray, part: np.ndarray, family: tuple[np.ndarray, np.ndarray], tails: bool, out: np.ndarray) -> None:
    """The signatures of sets that have few identities in common, every one hashed where it stands."""
    ends, lo = np.append(starts[1:], len(values)), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _FEW, side="right")))
        own = values[starts[lo] : ends[hi - 1]]
        x, tail = _mod(own.copy()), own >> _HALF
        for i, (p, q) in enumerate(zip(*family)):
            y = x * p
            y += q
            _mod(y)
            if tails:
                y <<= _HALF
                y |= tail
            out[part[lo:hi], i] = np.minimum.reduceat(y, starts[lo:hi] - starts[lo])
        lo = hi


def estimate_jaccard(x: Column, y: Column) -> Column:
    """Part of the positions at which two signatures agree; an error where their lengths differ."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), same / F.size(x)).otherwise(F.raise_error(F.lit("signatures of different length")).cast("double"))


def candidate_probability(s: float, bands: int, rows: int) -> float:
    """Chance that two sets of Jaccard similarity s share a band."""
    return 1.0 - (1.0 - s**rows) ** bands


def approx_threshold(bands: int, rows: int) -> float:
    """The similarity at which the S-curve is steepest, about."""
    return (1.0 / bands) ** (1.0 / rows)


@dataclasses.dataclass(frozen=True)
class BandingScheme:
    num_bands: int
    num_rows: int
    num_hash_functions: int | None = None

    def __post_init__(self) -> None:
        if self.num_bands < 1 or self.num_rows < 1:
            raise ConfigError("there has to be at least one band of at least one row")
        if self.num_hash_functions is None:
            object.__setattr__(self, "num_hash_functions", self.num_bands * self.num_rows)
        if self.num_bands * self.num_rows != self.num_hash_functions:
            raise ConfigError(f"{self.num_bands} x {self.num_rows} isn't {self.num_hash_functions}")

    @property
    def threshold(self) -> float:
        return approx_threshold(self.num_bands, self.num_rows)

    def slices(self) -> list[slice]:
        return [slice(i * self.num_rows, (i + 1) * self.num_rows) for i in range(self.num_bands)]

    def probability_at(self, s: float) -> float:
        return candidate_probability(s, self.num_bands, self.num_rows)

    def s_curve(self, spark: SparkSession, points: int = 101) -> DataFrame:
        """``(similarity, probability)`` at evenly spaced similarities from 0 to 1."""
        s = F.col("id") / F.lit(max(points - 1, 1))
        return spark.range(points).select(s.alias("similarity"), (1 - F.pow(1 - F.pow(s, F.lit(self.num_rows)), F.lit(self.num_bands))).alias("probability"))


def factorizations(n: int) -> list[tuple[int, int]]:
    return [(b, n // b) for b in range(1, n + 1) if n % b == 0]


def recommend_bands(n: int, target: float, floor: float = 0.95) -> tuple[int, int]:
    """Bands and rows with the highest knee that still catch pairs at ``target`` with probability ``floor``; where none do, those that catch most."""
    if n < 1:
        raise ConfigError(f"there has to be at least one hash function, not {n}")
    every = factorizations(n)
    good = [(b, r) for b, r in every if candidate_probability(target, b, r) >= floor]
    return max(good, key=lambda x: approx_threshold(*x)) if good else max(every, key=lambda x: candidate_probability(target, *x))


def recall_ceiling(similarity: Column, scheme: BandingScheme) -> Column:
    """The recall that banding alone allows for a pair, before any threshold."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(scheme.num_rows)), F.lit(scheme.num_bands))


def bloom_sizing(expected: int, rate: float) -> tuple[int, int]:
    """Bits (whole bytes, at least one) and hash functions of a Bloom filter."""
    if expected < 1:
        raise ConfigError(f"at least one item has to be expected, not {expected}")
    if not 0 < rate < 1:
        raise ConfigError(f"the rate has to be between 0 and 1, not {rate}")
    bits = max(8, -(-math.ceil(-expected * math.log(rate) / math.log(2) ** 2) // 8) * 8)
    return bits, max(1, round(bits / expected * math.log(2)))


class BloomFilter:
    """Set membership of pairs with false positives only, for use on the driver; the engine itself removes repeated pairs exactly."""

    def __init__(self, expected: int, rate: float = 0.01):
        self.bits, self.hashes = bloom_sizing(expected, rate)
        self._array = np.zeros(self.bits // 8, np.uint8)

    def _places(self, i: int, j: int) -> list[int]:
        import hashlib

        d = hashlib.blake2b(i.to_bytes(8, "little", signed=True) + j.to_bytes(8, "little", signed=True), digest_size=16).digest()
        x, y = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(x + k * y) % self.bits for k in range(self.hashes)]

    def __contains__(self, pair: tuple[int, int]) -> bool:
        return all(self._array[p >> 3] >> (p & 7) & 1 for p in self._places(*pair))

    def add_if_absent(self, i: int, j: int) -> bool:
        """Whether the pair was new, as far as the filter can tell."""
        places = self._places(i, j)
        new = not all(self._array[p >> 3] >> (p & 7) & 1 for p in places)
        for p in places:
            self._array[p >> 3] |= 1 << (p & 7)
        return new
