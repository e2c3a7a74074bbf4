"""Byte-level BPE encoding and decoding with segment trees over byte positions.

A text is cut into words by the public byte-level pattern (contractions,
letters, digits, other signs, white space). Each word is merged on its own: a
segment tree over its byte positions holds, per position, the rank of the pair
that starts there; the root is the leftmost pair of least rank. A merge
changes three leaves (the dead neighbour, the merged position, the live
neighbour before it), each a logarithmic point update.

Short words are merged many at a time, in a forest of equal trees held in one
array; long ones by a tree each. Equal words of a chunk are merged once.
Decoding gathers the bytes of the ids; every text is decoded again and
compared with its bytes.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.text import _BASE, chunks, mix
from quern.storage import table

VOCABULARY = os.environ.get("QUERN_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")  #: rank file
_LONG = 64  # bytes from which a word has a tree of its own
_KEPT = 150_000  # words remembered by a worker before it starts afresh
_NONE = np.int64(np.iinfo(np.int64).max)


class Vocabulary:
    """Ids and bytes of a rank file (a line holds base64 bytes and the rank, which is the id), and every mergeable pair."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        n = max(ranks.values()) + 1
        parts = [b""] * n
        for token, rank in ranks.items():
            parts[rank] = token
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        # open addressing with linear probing; the load is a quarter at most
        self.shift = np.uint64(64 - (len(pairs) * 4).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.zeros(size, np.int64)
        self.probes = 1
        slots = ((np.array(list(pairs), np.int64).astype(np.uint64) * _BASE) >> self.shift).astype(np.int64).tolist()
        for (key, rank), at in zip(pairs.items(), slots):
            steps = 1
            while self.keys[at] != -1:
                at = (at + 1) % size
                steps += 1
            self.probes = max(self.probes, steps)
            self.keys[at], self.ranks[at] = key, rank
        self.pairs = pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (and id) of the merged pair, or -1."""
        key = left << np.int64(20) | right
        at = ((key.astype(np.uint64) * _BASE) >> self.shift).astype(np.int64)
        out = np.where(self.keys[at] == key, self.ranks[at], -1)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merge_forest(vocabulary: Vocabulary, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge words of similar length together. ``words``: (words, longest) bytes, padded. Returns all ids in order and the number per word."""
    w, s = words.shape
    leaves = 1 << max(1, (s - 1).bit_length())
    ids = vocabulary.of_byte[words]
    live = np.arange(s) < lengths[:, None]
    before = np.tile(np.arange(-1, s - 1), (w, 1))
    after = np.where(np.arange(1, s + 1) < lengths[:, None], np.arange(1, s + 1), -1)
    tree = np.full((w, 2 * leaves), _NONE, np.int64)
    if s > 1:
        r = vocabulary.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(w, s - 1)
        tree[:, leaves : leaves + s - 1] = np.where((r >= 0) & live[:, 1:], r << 20 | np.arange(s - 1), _NONE)
    level = leaves
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + leaves
        tree[rows, node] = value
        while leaves > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            if node[0] == 1:  # all leaves are equally deep
                break

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[rows, at]
        r = vocabulary.rank(ids[rows, at], ids[rows, np.maximum(nxt, 0)])
        return np.where((nxt >= 0) & (r >= 0), r << 20 | at, _NONE)

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        root = tree[rows, 1]
        at, dead = root & 0xFFFFF, after[rows, root & 0xFFFFF]
        ids[rows, at] = root >> 20
        nxt = after[rows, dead]
        after[rows, at] = nxt
        has = nxt >= 0
        before[rows[has], nxt[has]] = at[has]
        live[rows, dead] = False
        update(rows, dead, np.full(len(rows), _NONE))
        update(rows, at, pair(rows, at))
        prev = before[rows, at]
        has = prev >= 0
        if has.any():
            update(rows[has], prev[has], pair(rows[has], prev[has]))
        rows = rows[tree[rows, 1] != _NONE]
    return ids[live], live.sum(axis=1)


def merge_one(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """Merge one word of any length with a tree of its own."""
    n, pairs = len(word), vocabulary.pairs
    ids = vocabulary.of_byte[np.frombuffer(word, np.uint8)].tolist()
    none = int(_NONE)
    leaves = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        r = pairs.get(ids[i] << 20 | ids[i + 1])
        if r is not None:
            tree[leaves + i] = r << 40 | i
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]

    def update(i: int) -> None:
        j = after[i]
        r = pairs.get(ids[i] << 20 | ids[j]) if j >= 0 and ids[i] >= 0 else None
        node = leaves + i
        tree[node] = none if r is None else r << 40 | i
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            new = a if a < b else b
            if tree[node] == new:
                break
            tree[node] = new
            node >>= 1

    while tree[1] != none:
        root = tree[1]
        i = root & 0xFFFFFFFFFF
        dead = after[i]
        ids[i] = root >> 40
        after[i] = after[dead]
        if after[i] >= 0:
            before[after[i]] = i
        ids[dead] = -1
        update(dead)
        update(i)
        if before[i] >= 0:
            update(before[i])
    return [x for x in ids if x >= 0]


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Per code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x323B0):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = 1 if k == "L" else 2
    for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[c] = 3
    return out


def word_starts(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code point index at which each word of the pattern begins, in order; no word crosses rows."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[cp]
    first = np.zeros(n + 1, bool)  # first of a row; the end counts as one
    first[off] = True
    begins = first[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]  # runs of one kind
    space = cp == 0x20
    white = kind == 3
    # the last of a run of white space before a sign stands alone or, if a blank, opens the next word
    last_white = white.copy()
    last_white[:-1] &= ~white[1:]
    last_white &= ~first[1:]
    at = np.flatnonzero(last_white)
    begins[at] = True
    joined = at[space[at]]
    begins[joined + 1] = False
    # contractions: an apostrophe that opens a word, with its letters
    quote = np.flatnonzero((cp == 0x27) & begins)
    if len(quote):
        room = np.append(cp, np.zeros(3, np.uint32))
        ends = off[np.searchsorted(off, quote, side="right")]
        a, b = room[quote + 1], room[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & (quote + 1 < ends)
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quote + 2 < ends)
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        after = quote + size
        begins[after[after < n]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes chunks; remembers the words that it has merged."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.sizes = np.zeros(1 << 12, np.int64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def _remember(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.at)
        while n + len(hashes) > len(self.sizes):
            self.sizes, self.begin = np.resize(self.sizes, 2 * len(self.sizes)), np.resize(self.begin, 2 * len(self.begin))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.at.update(zip(hashes, range(n, n + len(hashes))))
        self.sizes[n : n + len(hashes)] = sizes
        self.begin[n : n + len(hashes)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _merge(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Merge new words, by classes of length."""
        low = 0
        for high in (1, 2, 3, 5, 9, 17, 33, _LONG):
            which = np.flatnonzero((size > low) & (size <= high))
            low = high
            for k in range(0, len(which), step := max(1, (1 << 18) // high)):
                w = which[k : k + step]
                pick = start[w, None] + np.arange(high)
                ids, n = merge_forest(self.v, data[np.minimum(pick, len(data) - 1)], size[w])
                self._remember(hashes[w].tolist(), n, ids)
        for w in np.flatnonzero(size > _LONG):
            ids = merge_one(self.v, data[start[w] : start[w] + size[w]].tobytes())
            self._remember([int(hashes[w])], np.array([len(ids)]), np.array(ids))

    def encode(self, cp: np.ndarray, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk in order, and the offsets of the rows in them. ``data``: the chunk's UTF-8 bytes."""
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        begin = word_starts(cp, off)
        row = np.searchsorted(begin, off)
        if len(data) == len(cp):
            start = begin
        else:
            start = np.flatnonzero((data & 0xC0) != 0x80)[begin]
        size = np.diff(np.append(start, len(data)))
        within = np.arange(len(data)) - np.repeat(start, size)
        power = np.full(int(size.max()), _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        h = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[within], start) + size.astype(np.uint64))
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) > _KEPT:
            self.forget()
        known = self.at
        keys = unique.tolist()
        new = np.array([i for i, k in enumerate(keys) if k not in known], np.int64)
        if len(new):
            self._merge(data, unique[new], start[where[new]], size[where[new]])
        slot = np.array([known[k] for k in keys], np.int64)[inverse]
        count = self.sizes[slot]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[slot] - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[row]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of ids."""
        n = self.v.lengths[ids]
        ends = np.cumsum(n)
        return self.v.bytes[np.repeat(self.v.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


_MADE: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary, so that its memory of words lasts over tasks."""
    value = shared.value
    if id(value) not in _MADE:
        _MADE.clear()
        _MADE[id(value)] = Encoder(value)
    return _MADE[id(value)]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens, tokens, round_trip)`` for every row: the ids of the whole text, and whether decoding them gives its bytes back.

    Words are told apart by 64-bit hashes. Should two of one hash meet, the row does not decode to its bytes and is
    encoded again with nothing remembered; round_trip is false only if they meet within that row.
    An empty text has no tokens; a null text has null in all three columns; doc_id is passed through, null or
    repeated. The file of the vocabulary is read by the driver; its size, and so that of the broadcast, does not
    depend on the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in batches:
            text = b.column("text")
            for lo, hi, cp, off in chunks(text):
                data = np.frombuffer(cp.tobytes().decode("utf-32-le").encode(), np.uint8)
                ids, bounds = e.encode(cp, off, data)
                decoded = e.decode(ids)
                same = np.ones(hi - lo, bool)
                if not np.array_equal(decoded, data):
                    e.forget()
                    each = []
                    for r in range(hi - lo):  # two words of one hash, in memory or within the chunk: each row again, on its own
                        part = cp[off[r] : off[r + 1]]
                        raw = part.tobytes().decode("utf-32-le").encode()
                        own = ids[bounds[r] : bounds[r + 1]]
                        if e.decode(own).tobytes() != raw:
                            e.forget()
                            own, _ = e.encode(part, np.array([0, len(part)]), np.frombuffer(raw, np.uint8))
                            same[r] = e.decode(own).tobytes() == raw
                        each.append(own)
                    ids, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
                null = text.slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                starts = pa.array(bounds.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(bounds), mask=null), pa.ListArray.from_arrays(starts, pa.array(ids, pa.int32())), pa.array(same, mask=null)], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")


def decode(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, tokens)``. Null tokens give a null text, no tokens an empty one; ids beyond the vocabulary raise IndexError; bytes that are not UTF-8 (ids cut within a character) are replaced by U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in batches:
            lists = b.column("tokens")
            texts = [None if x is None else e.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, tokens, round_trip)`` of every document."""
    return encode(table(spark, sf_dir, "documents"))
