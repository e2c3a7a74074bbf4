"""Capture index: locally sorted runs merged by a loser tree into globally ordered capture histories.

Each task sorts its captures by URL key and time into runs, which are written
to the shared folder. The key space is then cut into ranges of about equal
size (a hot URL's captures may span several); a range is sent the pieces of all runs
that fall into it, and merges them with a k-way loser tree. Positions within
the whole index and within a URL's history, and whether a capture repeats the one before it, follow from one row
of bookkeeping per range.

The URL key is the host's labels reversed (without a leading www and without
user and port), then the path and query as written; a fragment does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.urls import _HOST
from quern.storage import observed, table, written

RUN_ROWS = 200_000  #: captures that are sorted at a time; a task with more makes several runs
RANGE_ROWS = 2_000_000  #: captures that a range holds about (some 200 MB)
_KEY = ("surt", "captured", "page_id", "digest")
_AHEAD = 1_024  # keys of a piece that are decoded at a time
_TAIL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^#]*)"


def url_key(url: Column) -> Column:
    """Sort-friendly key; empty for a URL that is null or not absolute."""
    name = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(name, r"^www\d*\.", ""), r"\.")), ",")
    tail = F.regexp_extract(url, _TAIL, 1)
    return F.coalesce(F.when(name != "", F.concat(labels, F.lit(")"), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))), F.lit(""))


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, node 0 the winner. ``heads[i]`` is the next key of run i, or None at its end."""

    def __init__(self, heads: list):
        self.k, self.heads = len(heads), heads
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; an ended run goes last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return x < y or (x == y and a < b)

    def _play(self, run: int) -> None:
        node, winner = (run + self.k) >> 1, run
        while node:
            other = self.tree[node]
            if other < 0:  # while the tree is built: wait here for the other side
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node >>= 1
        self.tree[0] = winner

    def merge(self, rest: list[Iterator]) -> Iterator[int]:
        """The runs' numbers in merged order; ``rest[i]`` gives the keys of run i after its first."""
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield w
            self.heads[w] = next(rest[w], None)
            self._play(w)


def _keys(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    """Comparable keys; a null time, page or digest goes first."""
    surt, captured, page, digest = (table[c].to_pylist() for c in _KEY)
    return [(s, c is not None, c or 0, p is not None, p or 0, d or "") for s, c, p, d in zip(surt, captured, page, digest)]


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = run = 0

    def close() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        keys = _keys(table)
        name = pa.array([(TaskContext.get().partitionId() << 24) + run] * len(keys), pa.int64())
        yield from table.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64())).append_column("run", name).combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN_ROWS:
            yield from close()
            held, n, run = [], 0, run + 1
    if n:
        yield from close()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's pieces of runs, merged. They are held as they came, in Arrow's form; keys are decoded a little ahead of the tree."""
    held, pieces = [], []
    for b in batches:
        if not b.num_rows:
            continue
        keys, runs = _keys(b), b.column("run").to_pylist()
        # a new piece begins with a batch, with another run or where the order breaks (two files of one range)
        starts = [0, *(i for i in range(1, len(keys)) if runs[i] != runs[i - 1] or keys[i] < keys[i - 1]), len(keys)]
        pieces += [(len(held), x, z) for x, z in zip(starts, starts[1:])]
        held.append(b.drop_columns("run"))

    def ahead(batch: int, first: int, end: int) -> Iterator[tuple]:
        for lo in range(first, end, _AHEAD):
            yield from _keys(held[batch].slice(lo, min(_AHEAD, end - lo)))

    rest = [ahead(*p) for p in pieces]
    before = np.cumsum([0, *(b.num_rows for b in held)])
    at = [int(before[b]) + lo for b, lo, _ in pieces]
    whole, order = pa.Table.from_batches(held) if held else None, []
    n = nth = 0
    last = None

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal n, nth, last
        table = whole.take(pa.array(order, pa.int64()))
        numbers = []
        for s in table["surt"].to_pylist():
            nth = nth + 1 if s == last else 1
            last = s
            numbers.append(nth)
        table = table.append_column("nth", pa.array(numbers, pa.int64())).append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int64())).append_column("at", pa.array(range(n, n + len(order)), pa.int64()))
        n += len(order)
        yield from table.combine_chunks().to_batches()

    for w in LoserTree([next(r) for r in rest]).merge(rest):
        order.append(at[w])
        at[w] += 1
        if len(order) == 1 << 16:
            yield from out()
            order = []
    if order:
        yield from out()


def capture_histories(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(position, surt, captured, page_id, nth, repeats, n_bytes, digest)``, one row per capture.

    ``captures`` has page_id, url, captured (whole seconds) and html. Rows are ordered by URL key (as UTF-8
    bytes), time, page_id and digest of the body, nulls first; ``position`` counts from 1 over all, ``nth`` from 1 within a key.
    ``repeats`` says whether the body equals that of the key's capture before. Null and relative URLs share the empty key.
    A null body has null digest and size and repeats nothing. Captures equal in all parts of the key are each
    kept. An empty table gives an empty one.
    """
    spark = captures.sparkSession
    rows = captures.select(url_key(F.col("url")).alias("surt"), F.col("captured").cast("long"), F.col("page_id").cast("long"), F.octet_length("html").cast("long").alias("n_bytes"), F.md5("html").alias("digest"))
    schema = "surt string, captured long, page_id long, n_bytes long, digest string"
    runs, seen = observed(rows.mapInArrow(_sorted_runs, schema + ", run long"), "runs", n=F.count("*"))
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // RANGE_ROWS))
    merged = written(runs.repartitionByRange(n, *_KEY).mapInArrow(_merged, schema + ", nth long, part long, at long"), "merged", [runs])
    ends = merged.groupBy("part").agg(F.count("*").alias("n"), F.min("surt").alias("first"), F.max("surt").alias("last"), F.max_by("nth", "at").alias("nth"), F.max_by("digest", "at").alias("digest")).orderBy("part").collect()
    before, carry, last, digest, book = 0, 0, None, None, []
    for e in ends:  # one row per range
        if e["first"] != last:
            carry, digest = 0, None
        book.append((e["part"], before, e["first"], carry, digest))
        carry = e["nth"] + (carry if e["first"] == e["last"] else 0)
        before, last, digest = before + e["n"], e["last"], e["digest"]
    books = spark.createDataFrame(book, "part long, before long, first string, carry long, end string")
    joined = merged.join(F.broadcast(books), "part")  # a row for every range
    previous = F.lag("digest").over(Window.partitionBy("part").orderBy("at"))
    carried = F.col("surt") == F.col("first")
    nth = F.col("nth") + F.when(carried, F.col("carry")).otherwise(0)
    former = F.when((F.col("nth") == 1) & carried, F.col("end")).when(F.col("nth") > 1, previous)
    return joined.select((F.col("before") + F.col("at") + 1).alias("position"), "surt", "captured", "page_id", nth.alias("nth"), F.coalesce(F.col("digest") == former, F.lit(False)).alias("repeats"), "n_bytes", "digest")


_TIME = "1704067200 + (page_id * 7919) % 31536000"


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histories of the table pages. It records no capture time, so one within 2024 is made from page_id."""
    return capture_histories(table(spark, sf_dir, "pages").withColumn("captured", F.expr(_TIME)))


SQL = f"""
WITH rows AS (
  SELECT page_id, html, {_TIME} AS captured, regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.$', '') AS name, regexp_extract(url, '{_TAIL}', 1) AS tail FROM pages
), keyed AS (
  SELECT CASE WHEN coalesce(name, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(name, '^www[0-9]*\\.', ''), '.')), ',') || ')' || CASE WHEN starts_with(tail, '/') THEN '' ELSE '/' END || tail END AS surt,
    captured, page_id, octet_length(encode(html))::BIGINT AS n_bytes, md5(html) AS digest
  FROM rows
)
SELECT row_number() OVER (ORDER BY surt, captured NULLS FIRST, page_id NULLS FIRST, digest NULLS FIRST) AS position, surt, captured, page_id,
  row_number() OVER w AS nth, coalesce(digest = lag(digest) OVER w, false) AS repeats, n_bytes, digest
FROM keyed WINDOW w AS (PARTITION BY surt ORDER BY captured NULLS FIRST, page_id NULLS FIRST, digest NULLS FIRST)
"""
