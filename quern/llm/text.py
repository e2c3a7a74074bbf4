"""Vectorised text access for Arrow batches: whole texts as code points, words as 64-bit hashes.

Nothing here loops over characters or words in Python. A chunk is a run of
whole rows of at most ``max_chars`` characters (a longer text is a chunk of its
own), so memory is bounded by the longest single text and never by the batch.
Null texts read as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64; wraps silently."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (where that is one character) and whether it belongs to a word (letter, digit or underscore)."""
    n = 0x110000
    low = np.arange(n, dtype=np.uint32)
    word = np.zeros(n, dtype=bool)
    for c in range(0x323B0):  # beyond this no letters are assigned but for private use
        s = chr(c)
        if s.isalnum() or s == "_":
            word[c] = True
            t = s.lower()
            if len(t) == 1:
                low[c] = ord(t)
    return low, word


#: First and last code points of scripts written without spaces: each of their letters is a word of its own.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x31FF), (0x3400, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF)]


@lru_cache(maxsize=1)
def unspaced() -> np.ndarray:
    """Per code point: whether it belongs to a script without spaces."""
    out = np.zeros(0x110000, dtype=bool)
    for a, z in _UNSPACED:
        out[a : z + 1] = True
    return out


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (one more than rows) of a string column, without copying the bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), off


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def chunks(col: pa.Array, max_chars: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, code points, offsets)`` of runs of whole rows; offsets count code points and start at 0."""
    data, off = string_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_chars, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        part = data[off[lo] : off[hi]]
        rel = off[lo : hi + 1] - off[lo]
        cp = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(cp) == len(part):
            yield lo, hi, cp, rel
        else:
            ends = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            yield lo, hi, cp, ends[rel]
        lo = hi
    _trim()(0)  # a worker serves stage after stage: what a batch took goes back to the system


def passed(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs`` through a function of batches that keeps the columns; their names, dotted ones too, stay out of it."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Words:
    """The words of one chunk, in order: runs of letters, digits and underscores; in scripts without spaces every letter.

    ``hash``: 64-bit hash of the lower-cased word. ``start``, ``end``: its code points. ``doc``: its row within
    the chunk. ``bounds``: for each row the first word and, last, the number of words.
    """

    __slots__ = ("bounds", "doc", "end", "hash", "start")

    def __init__(self, cp: np.ndarray, off: np.ndarray):
        low, word = tables()
        is_word = word[cp]
        at = np.flatnonzero(is_word)
        rows = len(off) - 1
        if not len(at):
            self.hash, self.start, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.doc, self.bounds = np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
            return
        new = np.empty(len(at), dtype=bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
        if int(cp.max()) >= _UNSPACED[0][0]:
            own = unspaced()[cp[at]]
            new |= own
            new[1:] |= own[:-1]
        first = np.searchsorted(at, off[:-1])  # a row boundary ends a word even without a separator
        new[first[first < len(at)]] = True
        first_at = np.flatnonzero(new)
        lengths = np.diff(np.append(first_at, len(at)))
        within = np.arange(len(at)) - np.repeat(first_at, lengths)
        power = np.full(int(lengths.max()), _BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        values = (low[cp[at]].astype(np.uint64) + np.uint64(1)) * power[within]
        self.hash = mix(np.add.reduceat(values, first_at) + lengths.astype(np.uint64))
        self.start = at[first_at]
        self.end = at[first_at + lengths - 1] + 1
        self.bounds = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(rows), np.diff(self.bounds))


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives to one word (reference form for tests)."""
    cp = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32)
    return int(Words(cp, np.array([0, len(cp)])).hash[0])


def gram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words within one row, and the index of its first word."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h * _BASE + words.hash[at + k])
    return h, at
