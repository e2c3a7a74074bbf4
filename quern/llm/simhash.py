"""SimHash near-duplicate removal by a grid range join over per-segment bit counts.

A fingerprint has 128 bits: the signs of the sums of +-1 over the hashes of a
text's distinct words. It is embedded as 64 counts, the set bits of each
two-bit segment. The Manhattan distance of two such vectors never exceeds the
Hamming distance of the fingerprints, so a range join on the counts misses no
pair; the exact Hamming distance decides.

The grid: tokens and segments are its axes. On the axis of the logarithm of the
number of tokens a point is in its own interval and, where a longer partner may
be there, in the next. The 64 axes of segments fall into 3 groups. Two
fingerprints at most ``K`` = 22 bits apart are at most 7, 7 or 6 apart in one of
them: were they more in each, the sum would be at least 8 + 8 + 7 = 23. The
cells of a group leave some of its bits open and fix the others. Every bit of a
group that may differ by r has a code of r + 1 bits, and there is a table for
every number v of r + 1 bits but 0, which fixes the bits whose codes have an odd
number of ones in common with v. The codes of any r bits leave a v that has an
even number in common with all of them, so whichever r bits differ, some table
leaves them all open, and the pair shares a cell there. So no pair is lost,
whatever its distance up to K, the size of the table and the other points.

These are 255 + 255 + 127 tables, whose cells hold a 1,700th of all pairs of
random points together, so they are made where they are looked at and not
shuffled: a task gets the points of an interval (of two blocks of ``BLOCK``
points where there are more) and a run of tables, sorts by each and compares
what shares a cell. Intervals of up to ``FEW`` points take 4 groups with 220
tables, which lose no pair either.

Definition of the result: two documents are near duplicates if their
fingerprints differ in at most ``K`` bits and the smaller number of tokens is
at least ``ratio`` of the larger. Classes are the connected components of that
relation; the row with the least doc_id of each class stays. A pair is counted
in the first table in which it meets, so that links are counted once without a
list of all pairs. A point knows how many texts it stands for, so that links
between different texts are counted whether or not they share a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text import Words, chunks, mix
from quern.operators.components import connected_components, forest
from quern.storage import observed, table, written

BITS, SEGMENTS = 128, 64
K = 22  #: bits that near duplicates may differ in
RATIO = 0.8  #: least quotient of their token counts
FEW = 1 << 14  #: points up to which 4 groups of axes cost less than 3; both lose no pair
BLOCK = 1 << 20  #: points of an interval that a task takes, or twice as many of two blocks
WORK = 1 << 22  #: points times tables of an interval that make a task; more make tasks by their root, as each gets all points
BROADCAST_IDS = 8_000_000  #: ids of dropped documents up to which they are broadcast (128 MB in the JVM)
_LANES = np.uint64(0x0101010101010101)
_EVEN = np.uint64(0x5555555555555555)
_SMALL = 48  # points up to which cells are compared side by side instead of one by one
_TOGETHER = 1 << 18  # pairs that are looked at together
_HELD = 1 << 22  # links that are summed together
_PIECE = 255  # words that byte lanes can count without overflow
_COLUMNS = [("f1", np.uint64), ("f2", np.uint64), ("point", np.int64), ("texts", np.int64), ("n", np.int32)]  # of a point in an interval


def fingerprints(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first 64 bits, last 64 bits, tokens)`` per row of a chunk, from the distinct words of each row. A row without words has all bits clear."""
    tokens = np.diff(words.bounds)
    out = np.zeros((2, rows), np.uint64)
    if not len(words.hash):
        return out[0], out[1], tokens
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    counts = np.bincount(d, minlength=rows)
    first = np.cumsum(counts) - counts
    pieces = -(-counts // _PIECE)
    total = int(pieces.sum())
    owner = np.repeat(np.arange(rows), pieces)
    nth = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + nth * _PIECE
    rows_with = np.flatnonzero(counts)
    piece_first = (np.cumsum(pieces) - pieces)[rows_with]
    for half in range(2):
        x = h if half == 0 else mix(h + np.uint64(0xA5A5A5A5A5A5A5A5))
        for bit in range(8):
            sums = np.add.reduceat((x >> np.uint64(bit)) & _LANES, starts)
            lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
            per_row = np.add.reduceat(lanes, piece_first, axis=0)
            on = 2 * per_row > counts[rows_with, None]
            shift = (np.arange(8) * 8 + bit).astype(np.uint64)
            out[half, rows_with] |= np.bitwise_or.reduce(on.astype(np.uint64) << shift, axis=1)
    return out[0], out[1], tokens


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("f1", "f2", "tokens")]))
def _prints(text: pa.Array) -> pa.Array:
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    for lo, hi, cp, off in chunks(text):
        f1, f2, n = fingerprints(Words(cp, off), hi - lo)
        for r in np.flatnonzero(n == 0):
            f1[r], f2[r] = np.frombuffer(blake2b(cp[off[r] : off[r + 1]].tobytes(), digest_size=16).digest(), np.uint64)
        for part, x in zip(parts, (f1.view(np.int64), f2.view(np.int64), n.astype(np.int64))):
            part.append(x)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in parts], ["f1", "f2", "tokens"])


def fingerprint_table(docs: DataFrame, *more: Column) -> DataFrame:
    """``(doc_id, ..., f1, f2, tokens)`` of every document. A text without words has 0 tokens and, in place of a fingerprint, a digest of itself."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, _prints(F.col("text")).alias("__print"))
    return rows.select(*(c for c in rows.columns if c != "__print"), "__print.f1", "__print.f2", "__print.tokens")


# --- the grid -------------------------------------------------------------------------------------------------
def embedded(f: np.ndarray) -> np.ndarray:
    """The counts of 32 two-bit segments of half a fingerprint, two bits each."""
    return (f & _EVEN) + ((f >> np.uint64(1)) & _EVEN)


def segment_counts(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    """The embedding spelt out: (points, 64) counts of set bits."""
    places = np.arange(0, 64, 2, dtype=np.uint64)
    return np.concatenate([(embedded(f)[:, None] >> places) & np.uint64(3) for f in (f1, f2)], axis=1).astype(np.uint8)


#: Codes of the bits of a group, by the number r of bits that may differ in it; found by a search for tables that fix about equally many bits.
_CODES = {
    7: [226, 253, 240, 145, 196, 105, 172, 249, 195, 156, 40, 140, 237, 55, 25, 121, 21, 239, 241, 72, 17, 233, 201, 194, 154, 90, 242, 203, 74, 60, 182, 66, 130, 141, 174, 200, 76, 86, 119, 231, 77, 62, 169, 234],
    6: [110, 121, 13, 113, 116, 16, 62, 101, 82, 111, 7, 26, 45, 80, 90, 48, 5, 14, 69, 39, 15, 122, 70, 12, 89, 24, 2, 25, 44, 114, 103, 54, 65, 33, 37, 76, 58, 77, 49, 83, 4, 102],
    5: [49, 25, 16, 53, 7, 47, 29, 6, 48, 3, 52, 46, 38, 11, 2, 56, 24, 57, 39, 42, 20, 61, 17, 34, 35, 28, 21, 43, 60, 10, 14, 15],
    4: [30, 14, 22, 11, 10, 4, 3, 25, 28, 5, 7, 8, 16, 19, 31, 12, 20, 17, 15, 29, 9, 26, 21, 1, 13, 27, 18, 2, 24, 23, 27, 6],
}


def _tables(sizes: list[int], radii: list[int]) -> np.ndarray:
    """(tables, 2) masks of the bits that the tables fix, for groups of so many axes that may differ by so many bits."""
    order = np.random.default_rng(20240611).permutation(SEGMENTS).tolist()
    masks = []
    for r in radii:
        axes, order = order[: sizes[0]], order[sizes[0] :]
        sizes = sizes[1:]
        bits = [2 * a + half for a in axes for half in range(2)]
        for v in range(1, 2 << r):
            fixed = sum(1 << b for b, code in zip(bits, _CODES[r]) if (code & v).bit_count() % 2)
            masks.append((fixed & (1 << 64) - 1, fixed >> 64))
    return np.array(masks, np.uint64)


KEYS = _tables([22, 21, 21], [7, 7, 6])
_KEYS_OF_FEW = _tables([16, 16, 16, 16], [5, 5, 5, 4])


def tables_of(points: int) -> np.ndarray:
    """(tables, 2) masks of the bits fixed by the tables that cost least for so many points. Those for any number find every pair."""
    return _KEYS_OF_FEW if points <= FEW else KEYS


def _width(ratio: float) -> float:
    return max(-math.log(ratio), 1e-6) * 2


def _tasks(cells: dict[int, int], tables: np.ndarray | None, block: int, work: int) -> tuple[dict[int, tuple[int, list[list[int]]]], list[tuple[np.ndarray, int, int, int, int]]]:
    """From the points of each interval: into how many blocks it falls and which tasks want each of them, and the tasks: their tables, of which they take those from the one number to before the other, and their two blocks."""
    wanted, tasks = {}, []
    for cell, n in sorted(cells.items()):
        blocks = -(-n // block)
        want: list[list[int]] = [[] for _ in range(blocks)]
        per = min(n, 2 * block)
        masks = tables_of(per) if tables is None else tables
        runs = min(len(masks), math.ceil(math.sqrt(per * len(masks) / work)))
        for a, b in [(a, b) for a in range(blocks) for b in range(a + 1, blocks)] or [(0, 0)]:
            for run in range(runs):
                for x in {a, b}:
                    want[x].append(len(tasks))
                tasks.append((masks, len(masks) * run // runs, len(masks) * (run + 1) // runs, a, b))
        wanted[cell] = blocks, want
    return wanted, tasks


def _block_of(point: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(point.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _blocks(points: DataFrame, wanted: dict[int, tuple[int, list[list[int]]]]) -> DataFrame:
    """``(task, blocks, data)``: points for the tasks of their intervals, packed. A visitor from the interval below has a negative number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f1, f2, point, texts, tokens, own = (b.column(c).to_numpy() for c in ("f1", "f2", "point", "texts", "tokens", "own"))
            above = np.flatnonzero(b.column("above").to_numpy(zero_copy_only=False))
            pick = np.concatenate([np.arange(len(own)), above])
            cell = np.concatenate([own, own[above] + 1])
            columns = f1[pick], f2[pick], point[pick], texts[pick], np.concatenate([tokens, -tokens[above]]).astype(np.int32)
            task, count, data = [], [], []
            for c in np.unique(cell).tolist():
                blocks, want = wanted[c]
                at = np.flatnonzero(cell == c)
                block = _block_of(columns[2][at], blocks)
                for x in np.unique(block).tolist():
                    mine = at[block == x]
                    packed = b"".join(y[mine].tobytes() for y in columns)
                    for t in want[x]:
                        task.append(t)
                        count.append(blocks)
                        data.append(packed)
                        if len(data) >= 1 << 10:
                            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], ["task", "blocks", "data"])
                            task, count, data = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(task, pa.int32()), pa.array(count, pa.int64()), pa.array(data, pa.binary())], ["task", "blocks", "data"])

    return points.mapInArrow(run, "task int, blocks long, data binary")


def _unpacked(data: list[bytes]) -> list[np.ndarray]:
    """The columns of all blocks of a task."""
    width = sum(np.dtype(kind).itemsize for _, kind in _COLUMNS)
    out = []
    before = 0
    for _, kind in _COLUMNS:
        out.append(np.concatenate([np.frombuffer(x, kind, len(x) // width, len(x) // width * before) for x in data]))
        before += np.dtype(kind).itemsize
    return out


def _candidates(cell: np.ndarray, f1: np.ndarray, f2: np.ndarray, k: int, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in equal cells (``cell`` is sorted) whose fingerprints are at most k bits apart; where many are, without those that met in the tables before."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cell)))
    small = np.flatnonzero((size > 1) & (size <= _SMALL))
    many = size[small]
    left = np.repeat(np.cumsum(many), many) - 1 - np.arange(many.sum())  # points behind each in its cell
    at = np.repeat(first[small] + many, many) - 1 - left
    step = 1
    while len(at := at[left >= step]):  # each with the one so many places behind it, all small cells at once
        left = left[left >= step]
        near = at[np.bitwise_count(f1[at] ^ f1[at + step]) + np.bitwise_count(f2[at] ^ f2[at + step]) <= k]
        yield near, near + step
        step += 1
    for c in np.flatnonzero(size > _SMALL).tolist():
        x1, x2 = (f[first[c] : first[c] + size[c]] for f in (f1, f2))
        rows = max(1, (1 << 16) // len(x1))
        for lo in range(0, len(x1) - 1, rows):
            d1, d2 = (x[lo : lo + rows, None] ^ x[None, lo + 1 :] for x in (x1, x2))
            near = np.bitwise_count(d1) + np.bitwise_count(d2) <= k
            if 8 * np.count_nonzero(near) > near.size:
                for m1, m2 in before:
                    near &= ((d1 & m1) | (d2 & m2)) != 0
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            up = j >= i  # column j is point lo + 1 + j
            yield first[c] + lo + i[up], first[c] + lo + 1 + j[up]


def _first_key(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray], tables: np.ndarray | None = None) -> np.ndarray:
    """The first of the tables (``KEYS`` if none are given) in which each pair of fingerprints meets; ``len(KEYS)`` where there is none."""
    x1, x2 = (a ^ b for a, b in zip(f, g))
    tables = KEYS if tables is None else tables
    out = np.full(len(x1), len(KEYS), np.int64)
    open_ = np.arange(len(x1))
    for lo in range(0, len(tables), 8):
        first = np.full(len(open_), len(KEYS), np.int64)
        for t in reversed(range(lo, min(lo + 8, len(tables)))):
            first[((x1 & tables[t, 0]) | (x2 & tables[t, 1])) == 0] = t
        out[open_] = first
        left = np.flatnonzero(first == len(KEYS))
        if not len(left):
            break
        open_, x1, x2 = open_[left], x1[left], x2[left]
    return out


def _met(f1: np.ndarray, f2: np.ndarray, tables: np.ndarray, lo: int, hi: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, table)`` of pairs of positions at most k bits apart, in the tables of the run in which they meet (in the first of all at least, if that is in the run)."""
    bits = np.uint64(max(1, (len(f1) - 1).bit_length()))
    place = np.arange(len(f1), dtype=np.uint64)
    for t in range(lo, hi):
        h = (f1 & tables[t, 0]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= (f2 & tables[t, 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h >>= bits  # equal cells have equal hashes; others may, and are told apart by the distance
        h <<= bits
        h |= place
        h.sort()
        cell = h >> bits
        same = cell[1:] == cell[:-1]
        shared = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        at = (h[shared] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        for i, j in _candidates(cell[shared], f1[at], f2[at], k, tables[max(0, t - 8) : t]):
            yield at[i], at[j], np.full(len(i), t)


def _gathered(pairs: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs, many at a time."""
    held, n = [], 0
    for found in pairs:
        if len(found[0]):
            held.append(found)
            n += len(found[0])
        if n > _TOGETHER:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _links_of(f1: np.ndarray, f2: np.ndarray, point: np.ndarray, texts: np.ndarray, n: np.ndarray, blocks: int, task: tuple[np.ndarray, int, int, int, int], k: int, ratio: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Every link that the task has to count, as its two points and the texts of each: first met in one of its tables, and between its blocks or, where no other task has them together, within one."""
    tables, lo, hi, a, b = task
    block = _block_of(point, blocks)
    within = [x for x in {a, b} if (x == a and b <= a + 1) or (x == b == blocks - 1 and a == b - 1)]
    whole = np.isin(np.arange(blocks), within)
    tokens = np.abs(n)
    for i, j, t in _gathered(_met(f1, f2, tables, lo, hi, k)):
        ok = (n[i] > 0) | (n[j] > 0)  # two visitors meet in their own interval
        ok &= np.minimum(tokens[i], tokens[j]) >= ratio * np.maximum(tokens[i], tokens[j])
        ok &= (block[i] != block[j]) | whole[block[i]]
        i, j, t = i[ok], j[ok], t[ok]
        ok = _first_key((f1[i], f2[i]), (f1[j], f2[j]), tables) == t
        if ok.any():
            i, j = i[ok], j[ok]
            yield point[i], point[j], texts[i], texts[j]


def _links(blocks: DataFrame, tasks: list[tuple[np.ndarray, int, int, int, int]], k: int, ratio: float) -> DataFrame:
    """``(i, j, n)``: edges between points that connect what is linked (j is not null), and (j null) numbers of texts that a point i is linked to."""
    sets = list({id(t[0]): t[0] for t in tasks}.values())  # the masks are sent once
    plans = [(next(x for x, masks in enumerate(sets) if masks is t[0]), *t[1:]) for t in tasks]

    def joined(task: int, count: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        which, *rest = plans[task]
        held, n = [], 0
        for found in _links_of(*_unpacked(data), count, (sets[which], *rest), k, ratio):
            held.append(found)
            n += len(found[0])
            if n > _HELD:
                yield from _summed(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            yield from _summed(*map(np.concatenate, zip(*held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:  # sorted by task
            for t, count, data in zip(b.column("task").to_pylist(), b.column("blocks").to_pylist(), b.column("data")):
                if now and t != now[0]:
                    yield from joined(*now, held)
                    held = []
                now = t, count
                held.append(data.as_py())
        if now:
            yield from joined(*now, held)

    spread = blocks.repartitionById(max(1, min(len(tasks), 100_000)), "task").sortWithinPartitions("task")
    return spread.mapInArrow(run, "i long, j long, n long")


def _summed(i: np.ndarray, j: np.ndarray, texts_i: np.ndarray, texts_j: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n = np.zeros(len(ends), np.int64)
    np.add.at(n, at, np.concatenate([texts_j, texts_i]))
    if len(i) > 2 * len(ends):  # a dense class: a spanning forest connects it as well
        j, i = forest(i, j)
        i, j = i[i != j], j[i != j]
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.nulls(len(i), pa.int64())], ["i", "j", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(ends), pa.nulls(len(ends), pa.int64()), pa.array(n)], ["i", "j", "n"])


def near_duplicates(points: DataFrame, k: int = K, ratio: float = RATIO, tables: np.ndarray | None = None, block: int = BLOCK, work: int = WORK) -> DataFrame:
    """From ``(point, f1, f2, tokens)`` with distinct points, and ``texts``, the number of different texts of each, where it is not 1: ``(i, j, n)`` as :func:`_links` gives them. ``tables`` are chosen by the number of points of an interval where none are given; they, ``block`` and ``work`` don't change the links."""
    if k > K:
        raise ValueError(f"the tables find pairs of at most {K} bits' difference")
    width, length = _width(ratio), F.log(F.col("tokens").cast("double"))
    own = F.floor(length / width)
    texts = F.col("texts") if "texts" in points.columns else F.lit(1).cast("long").alias("texts")
    placed = points.select("point", "f1", "f2", "tokens", texts, own.alias("own"), (F.floor((length - math.log(ratio) + 1e-9) / width) > own).alias("above"))
    cells: dict[int, int] = {}
    for r in placed.groupBy("own").agg(F.count("*").alias("n"), F.count_if("above").alias("above")).collect():
        cells[r["own"]] = cells.get(r["own"], 0) + r["n"]
        if r["above"]:
            cells[r["own"] + 1] = cells.get(r["own"] + 1, 0) + r["above"]
    wanted, tasks = _tasks(cells, tables, block, work)
    return _links(_blocks(placed, wanted), tasks, k, ratio)


def _points(prints: DataFrame, k: int, ratio: float) -> DataFrame:
    """``(f1, f2, tokens, root, class_id, links)`` of every distinct fingerprint and length of rows with a doc_id; ``root`` names the class even where rows repeat a doc_id. Where ``prints`` have no ``digest`` of the text, a fingerprint and length count as one text."""
    texts = F.count_distinct("digest") if "digest" in prints.columns else F.lit(1).cast("long")
    grouped = prints.where("doc_id is not null").groupBy("f1", "f2", "tokens").agg(F.min("doc_id").alias("least"), texts.alias("texts"))
    points = written(grouped.withColumn("point", F.monotonically_increasing_id()), "points")
    found = written(near_duplicates(points.where("tokens > 0"), k, ratio), "links")
    parts = connected_components(found.where("j is not null"))
    counted = found.where("j is null").groupBy(F.col("i").alias("node")).agg(F.sum("n").alias("links"))
    linked = points.join(parts.join(counted, "node"), F.col("point") == F.col("node"))
    classes = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    linked = linked.join(classes, "component").select("point", F.col("component").alias("root"), "class_id", "links")
    links = F.when(F.col("tokens") > 0, F.coalesce("links", F.lit(0)) + F.col("texts") - 1).otherwise(0)
    known = points.join(linked, "point", "left").select("f1", "f2", "tokens", F.coalesce("root", "point").alias("root"), F.coalesce("class_id", "least").alias("class_id"), links.alias("links"))
    return written(known, "classes", [points, found, parts])


def near_duplicate_classes(docs: DataFrame, k: int = K, ratio: float = RATIO) -> DataFrame:
    """``(doc_id, class_id, links)``, one row per row of ``docs``: the least doc_id of its class, and how many different texts of other rows with a doc_id its own is a near duplicate of.

    Rows with equal fingerprint and token count are one point, so thousands of copies cost no comparisons; copies of
    a text count as one, different texts (told apart by MD5) each, also those of one fingerprint and token count.
    Texts without words (null, empty, punctuation only) are in one class when the texts are equal, null counting
    as empty, and have no links. A row with a null doc_id belongs to no class and gets nulls; rows that repeat a
    doc_id are judged each by its own text. An empty table gives an empty one. Texts are never cut.
    """
    prints = written(fingerprint_table(docs, F.unhex(F.md5("text")).alias("digest")), "prints")
    known = _points(prints, k, ratio)
    joined = prints.join(known, ["f1", "f2", "tokens"], "left")
    own = F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.when(own, F.col("class_id")).alias("class_id"), F.when(own, F.col("links")).alias("links"))


def without_near_duplicates(docs: DataFrame, k: int = K, ratio: float = RATIO, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: one row per class, the one with the least doc_id.

    Rows with a null doc_id stay. Rows that repeat a doc_id are judged each by its own text; of those of one class
    the one with the least text stays (null first), then the one whose columns are least as JSON. Other columns of
    ``docs`` may have any name. Up to ``broadcast_ids`` of the ids that go (or repeat) are broadcast, so that no
    text is shuffled; more are joined, with the same result.
    """
    prints = written(fingerprint_table(docs), "prints")
    known = _points(prints, k, ratio)
    rows = prints.where("doc_id is not null").join(known, ["f1", "f2", "tokens"])
    ids = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    marked, seen = observed(ids.where("class_id != doc_id or n > 1").select("doc_id", F.col("n").alias("n")), "marked", [prints], n=F.count("*"), again=F.count_if(F.col("n") > 1))
    near = (lambda t: F.broadcast(t)) if seen["n"] <= broadcast_ids else (lambda t: t)
    own = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long")
    keyed = docs.select("*", own.alias("__id"))
    gone = near(marked.select(F.col("doc_id").alias("__gone")))
    once = keyed.join(gone, F.col("__id") == F.col("__gone"), "left_anti").drop("__id")
    if not seen["again"]:
        return once
    again = near(marked.where("n > 1").select(F.col("doc_id").alias("__gone")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    repeated = keyed.join(again, F.col("__id") == F.col("__gone"), "left_semi").drop("__id")
    judged = fingerprint_table(repeated, F.struct(*names).alias("__row")).join(known, ["f1", "f2", "tokens"]).where("class_id = doc_id")
    first = judged.groupBy("doc_id", "root").agg(F.min_by("__row", F.struct(F.col("__row.text").isNotNull(), F.col("__row.text"), F.to_json("__row"))).alias("__row"))
    return once.union(first.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, class_id, links)`` of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
