"""Benchmark decontamination: word n-grams of the test items find passages, Smith-Waterman alignment scores them.

The seeds of an item are all its runs of three words, however often documents
hold them: which of them an edit leaves whole differs from copy to copy. A
passage around a seed, as long as the item with a margin on both sides,
that holds enough of the item's words to reach the threshold at all
is aligned with the item word by word: a local alignment with +2 for an equal
word and -1 for a replaced, missing or added one. The score is that sum over the
most it could be, 2 x the item's words; from ``THRESHOLD`` on the document
holds the item, exact or edited. Words are runs of letters and digits, single
letters in scripts without spaces.

Parts of an item of fewer than ``SHORT`` words are no evidence: it must stand
there whole (score 1), and one of fewer than three words, which has no seed,
must be the whole text of the document.

Nothing of a document is shuffled: items and seeds are broadcast, at most
``SLICE_WORDS`` words of items at a time. A larger benchmark is taken in
several slices, each one more pass over the documents, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.text import Words, chunks, gram_hashes, mix, passed
from quern.storage import table

SEED = 3
SHORT = 5  #: words from which a part of an item counts
THRESHOLD = 0.45
SLICE_WORDS = 4_000_000
POSTINGS = 1_000_000  #: occurrences of seeds that are looked at together, and words of passages; a row is not divided
MATCH, OTHER = 2, 1
_BITS = 22


class Items:
    """Words of the items of one slice and their seeds, ready to look up."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.words = [], []
        self.brief: dict[tuple, list[int]] = {}
        seeds, owner, place = [], [], []
        for lo, hi, cp, off in chunks(pa.array(texts, pa.string())):
            w = Words(cp, off)
            h, at = gram_hashes(w, SEED)
            of = w.doc[at]
            for r in range(hi - lo):
                if w.bounds[r + 1] > w.bounds[r]:
                    if w.bounds[r + 1] - w.bounds[r] < SEED:
                        self.brief.setdefault(tuple(w.hash[w.bounds[r] : w.bounds[r + 1]].tolist()), []).append(len(self.ids))
                    mine = np.flatnonzero(of == r) if hi - lo < 2 else slice(*np.searchsorted(of, [r, r + 1]))
                    seeds.append(h[mine])
                    place.append(at[mine] - w.bounds[r])
                    owner.append(np.full(len(seeds[-1]), len(self.ids)))
                    self.ids.append(ids[lo + r])
                    self.words.append(w.hash[w.bounds[r] : w.bounds[r + 1]])
        none = [np.zeros(0, np.int64)]
        seed = np.concatenate(seeds or [np.zeros(0, np.uint64)])
        order = np.argsort(seed, kind="stable")
        self.owner, self.place = np.concatenate(owner or none)[order], np.concatenate(place or none)[order]
        self._index(seed[order])
        self.size = np.array([len(w) for w in self.words], np.int64)

    def _index(self, seed: np.ndarray) -> None:
        """``seeds``: distinct, sorted; ``first``: where the postings of each begin (and the end); ``bitmap``: leading bits in use."""
        self.seeds, first = np.unique(seed, return_index=True)
        self.first = np.append(first, len(seed))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(word index, seed index)`` of every seed in a chunk."""
        h, at = gram_hashes(words, SEED)
        maybe = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)]) if len(self.seeds) else []
        if not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.seeds, h[maybe]), len(self.seeds) - 1)
        same = self.seeds[k] == h[maybe]
        return at[maybe[same]], k[same]


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage (arrays of word hashes), many at a time.

    The row recurrence's dependence to the left, max over k <= j of t[k] - (j - k), is a running maximum of
    t[k] + k, less j.
    """
    out = np.zeros(len(items), np.int64)
    sizes = np.array([(len(p), len(i)) for i, p in zip(items, passages)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    lo = 0
    while lo < len(order):
        hi, room = lo + 1, max(1, (1 << 18) // max(1, sizes[order[lo], 0]))
        while hi < len(order) and hi - lo < room and sizes[order[hi], 0] <= sizes[order[lo], 0] * 1.25 + 8:
            hi += 1
        batch = order[lo:hi]
        m, w = sizes[batch, 1].max(), sizes[batch, 0].max()
        a, b = np.zeros((len(batch), m), np.uint64), np.ones((len(batch), w), np.uint64)
        for r, x in enumerate(batch):
            a[r, : len(items[x])], b[r, : len(passages[x])] = items[x], passages[x]
        h = np.zeros((len(batch), w + 1), np.int32)
        best = np.zeros(len(batch), np.int32)
        ramp = np.arange(w + 1, dtype=np.int32) * OTHER
        for i in range(m):
            t = np.zeros_like(h)
            t[:, 1:] = np.maximum(np.maximum(h[:, :-1] + np.where(a[:, i, None] == b, MATCH, -OTHER).astype(np.int32), h[:, 1:] - OTHER), 0)
            h = np.maximum.accumulate(t + ramp, axis=1) - ramp
            np.maximum(best, h.max(axis=1), out=best)
        out[batch] = best
        lo = hi
    return out


def _held(items: Items, words: Words, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many of each item's words its passage holds; no alignment has more equal words."""
    out = np.zeros(len(item), np.int64)
    n = hi - lo
    ends = np.cumsum(n)
    first = 0
    while first < len(item):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + POSTINGS, "right")))
        size, m = items.size[item[first:last]], n[first:last]
        which = np.repeat(np.arange(len(m)), m)
        at = np.arange(len(which)) + np.repeat(lo[first:last] - (np.cumsum(m) - m), m)
        of = np.repeat(np.arange(len(m)), size)
        mine = mix(np.concatenate([items.words[i] for i in item[first:last]]) + mix(of.astype(np.uint64)))
        out[first:last] = np.bincount(of[np.isin(mine, mix(words.hash[at] + mix(which.astype(np.uint64))))], minlength=len(m))
        first = last
    return out


def aligned(items: Items, words: Words, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, item index, score)`` for each pair of a chunk that shares a seed and may reach the threshold: the best of its passages. Short items count where they are whole."""
    size = np.diff(words.bounds)
    brief = []
    for r in np.flatnonzero((size > 0) & (size < SEED)).tolist() if items.brief else ():
        brief += [(r, i) for i in items.brief.get(tuple(words.hash[words.bounds[r] : words.bounds[r + 1]].tolist()), ())]
    row, item, score = _by_seeds(items, words, threshold)
    ok = (items.size[item] >= SHORT) | (score >= 1)
    return np.append(row[ok], [r for r, _ in brief]).astype(np.int64), np.append(item[ok], [i for _, i in brief]).astype(np.int64), np.append(score[ok], np.ones(len(brief)))


def _by_seeds(items: Items, words: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, k = items.hits(words)
    n = items.first[k + 1] - items.first[k]
    rows, begin = np.unique(words.doc[at], return_index=True)
    found, total = [], np.append(np.cumsum(n) - n, n.sum())[np.append(begin, len(at))]
    begin = np.append(begin, len(at))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(total, total[i] + POSTINGS, "right")) - 1)
        s = slice(begin[i], begin[j])
        found.append(_aligned(items, words, at[s], k[s], n[s], threshold))
        i = j
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, np.zeros(0))


def _aligned(items: Items, words: Words, at: np.ndarray, k: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(n)
    posting = np.repeat(items.first[k] - (ends - n), n) + np.arange(ends[-1])
    at = np.repeat(at, n)
    item, row = items.owner[posting], words.doc[at]
    start = at - items.place[posting]  # where the item would begin
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    margin = items.size[item] // 3 + 4
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > margin[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, item, margin = row[first], item[first], margin[first]
    lo = np.maximum(start[first] - margin, words.bounds[row])
    hi = np.minimum(start[last] + items.size[item] + margin, words.bounds[row + 1])
    may = np.flatnonzero(_held(items, words, item, lo, hi) >= threshold * items.size[item] - 1e-9)
    row, item, lo, hi = row[may], item[may], lo[may], hi[may]
    if not len(row):
        return row, item, np.zeros(0)
    score = smith_waterman([items.words[i] for i in item], [words.hash[a:b] for a, b in zip(lo, hi)]) / (MATCH * items.size[item])
    pair = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
    return row[pair], item[pair], np.maximum.reduceat(score, pair)


def _slices(benchmark: DataFrame) -> Iterator[Items]:
    """Items in slices of bounded size, read from Spark in order of item_id; rows that repeat count each."""
    ids, texts, words = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        words += r[1].count(" ") + r[1].count("\n") + 1
        if words >= SLICE_WORDS:
            yield Items(ids, texts)
            ids, texts, words = [], [], 0
    if texts:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, score)`` of every document row and item from the threshold on.

    Null or empty texts on either side, items without words and an empty benchmark give no rows; a null doc_id or item_id is passed through; rows that repeat give rows that repeat.
    """
    kind = "doc_id long, item_id long, score double"
    found = docs.sparkSession.createDataFrame([], kind)
    for items in _slices(benchmark):
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id").cast(pa.int64())
                for lo, _, cp, off in chunks(b.column("text")):
                    row, item, score = aligned(shared.value, Words(cp, off), threshold)
                    ok = score >= threshold
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[ok] + lo)), pa.array([shared.value.ids[i] for i in item[ok]], pa.int64()), pa.array(score[ok])], ["doc_id", "item_id", "score"])

        found = found.union(docs.select("doc_id", "text").mapInArrow(run, kind))
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all columns as they are."""
    text = docs.columns.index("text")
    for items in _slices(benchmark):
        if not items.ids:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, cp, off in chunks(b.column(text)):
                    row, _, score = aligned(shared.value, Words(cp, off), threshold)
                    keep[row[score >= threshold] + lo] = False
                yield b.filter(pa.array(keep))

        docs = passed(docs, run)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, item_id, score)`` of every leak."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
