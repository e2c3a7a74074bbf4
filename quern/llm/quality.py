"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated probabilities.

A token is a run of word characters or a run of other signs, as written. It
falls into one of 2^15 buckets. Random indexing gives each bucket a fixed
sparse index vector (two entries of +-1 among 32); the vector of a word is the
sum of the index vectors of its neighbours within two tokens, over every
occurrence in every document, plus its own, scaled to length 1. The sums are
integers, added up per task and then per block of buckets, so what is gathered
is 4 MB a task whatever the vocabulary.

A document is pooled to the mean and the standard deviation of its token
vectors. The network is fitted on at most ``TRAIN_ROWS`` labelled documents
(of the labels that have a document, those of least hash of doc_id); a fifth of them is held out to fit the
temperature that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.text import _BASE, chunks, mix, passed, tables
from quern.storage import table

VOCABULARY, DIM, WINDOW, BLOCKS = 1 << 15, 32, 2, 64
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.02, 1e-4
THRESHOLD = 0.5  #: calibrated probability below which a document is rejected


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs, (VOCABULARY, 2) each, of the two non-zero entries of every index vector."""
    h = mix(np.arange(VOCABULARY, dtype=np.uint64) + np.uint64(77))
    first = (h % np.uint64(DIM)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(20)) % np.uint64(DIM - 1)).astype(np.int64)) % DIM
    signs = np.stack([(h >> np.uint64(50)) & np.uint64(1), (h >> np.uint64(51)) & np.uint64(1)], axis=1).astype(np.int64) * 2 - 1
    return np.stack([first, second], axis=1), signs


_WHITE: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Per code point: 0 white space, 1 word character, 2 other."""
    if not _WHITE:
        kind = np.where(tables()[1], 1, 2).astype(np.uint8)
        kind[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
        _WHITE.append(kind)
    return _WHITE[0]


def token_buckets(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of a chunk, in order, and for each row the index of its first one (and the end)."""
    kind = _kinds()[cp]
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[at[1:]] != kind[at[:-1]])
    rows = np.searchsorted(at, off)
    new[rows[rows < len(at)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    power = np.full(int(size.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    h = np.add.reduceat((cp[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - np.repeat(first, size)], first)
    return (mix(h) % np.uint64(VOCABULARY)).astype(np.int64), np.searchsorted(first, rows)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(VOCABULARY, DIM) float32 of unit length, from every token of every document."""
    places, signs = index_vectors()
    per = VOCABULARY // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY * DIM, np.int64)
        for b in batches:
            for _, _, cp, off in chunks(b.column("text")):
                t, bounds = token_buckets(cp, off)
                row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
                for d in range(1, WINDOW + 1):
                    near = np.flatnonzero(row[:-d] == row[d:]) if len(t) > d else np.zeros(0, np.int64)
                    a, z = t[near], t[near + d]
                    word, other = np.concatenate([a, z]) * DIM, np.concatenate([z, a])
                    for e in range(2):
                        total += np.bincount(word + places[other, e], weights=signs[other, e], minlength=len(total)).astype(np.int64)
        for k, part in enumerate(total.reshape(BLOCKS, per * DIM)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("block").to_pylist(), b.column("sums")):
                got = np.frombuffer(part.as_buffer(), np.int64)
                sums[k] = sums[k] + got if k in sums else got
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.tobytes()], pa.binary())], ["block", "sums"])

    kind = "block long, sums binary"
    found = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).toArrow()
    out = np.zeros((BLOCKS, per * DIM))
    for k, part in zip(found["block"].to_pylist(), found["sums"]):
        out[k] += np.frombuffer(part.as_buffer(), np.int64)
    out = out.reshape(VOCABULARY, DIM)
    for e in range(2):
        out[np.arange(VOCABULARY), places[:, e]] += signs[:, e]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(cp: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(features (rows, 2 DIM), tokens)`` of a chunk; zeros for a row without tokens."""
    t, bounds = token_buckets(cp, off)
    n = np.diff(bounds)
    out = np.zeros((len(n), 2 * DIM), np.float64)
    full = np.flatnonzero(n)
    for d in range(DIM) if len(full) else ():
        x = vectors[:, d][t].astype(np.float64)
        mean = np.add.reduceat(x, bounds[:-1][full]) / n[full]
        square = np.add.reduceat(x * x, bounds[:-1][full]) / n[full]
        out[full, d] = mean
        out[full, DIM + d] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out, n


class Network:
    """Input scaling, a hidden layer of tanh units, one logit, a temperature."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        zt, yt = z[train], y[train].astype(float)
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(zt @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -40, 40))) - yt) / len(yt)
            back = np.outer(d, w[2]) * (1 - hidden * hidden)
            grads = [zt.T @ back + DECAY * w[0], back.sum(axis=0), hidden.T @ d + DECAY * w[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(held):
            logit, yh = self.logit(x[held]), y[held]
            temperatures = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
            loss = [np.mean(np.logaddexp(0, -np.where(yh > 0, 1, -1) * logit / t)) for t in temperatures]
            self.temperature = float(temperatures[int(np.argmin(loss))])
        self.held = held
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors of all documents and the network fitted on at most ``rows`` labelled ones.

    Labels with a null doc_id or quality do not count; of repeated labels the majority decides, 1 on a tie. Labels
    without a document do not count. The network is None where fewer than two labelled documents or only one
    class are left.
    """
    vectors = word_vectors(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("q"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    picked = {r["doc_id"]: r["q"] >= 0.5 for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    ids = np.array(sorted(picked), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((ids, vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, v = shared.value
        for b in batches:
            doc = b.column("doc_id").cast(pa.int64()).fill_null(-(2**62))
            b = b.filter(pa.array(np.isin(doc.to_numpy(), wanted)))
            for lo, hi, cp, off in chunks(b.column("text")):
                x, _ = pooled(cp, off, v)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * DIM).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    table = docs.select("doc_id", "text").mapInArrow(features, "doc_id long, x array<double>").toArrow().sort_by("doc_id")
    y = np.array([picked[i] for i in table["doc_id"].to_pylist()])
    if len(y) < 2 or y.all() or not y.any():
        return vectors, None
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM)
    order = np.lexsort((*x.T[::-1], table["doc_id"].to_numpy()))  # rows of a repeated doc_id in a fixed order
    return vectors, Network().fit(x[order], y[order])


def _probabilities(model: tuple[np.ndarray, Network | None], text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probability of each row (0 without tokens, NaN without a network) and whether it is kept."""
    vectors, network = model
    p = np.full(len(text), np.nan)
    keep = np.ones(len(text), bool)
    for lo, hi, cp, off in chunks(text):
        x, n = pooled(cp, off, vectors)
        if network is not None:
            p[lo:hi] = np.where(n > 0, network.probability(x), 0.0)
            keep[lo:hi] = p[lo:hi] >= THRESHOLD
        else:
            keep[lo:hi] = n > 0
    return p, keep


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, probability, keep)`` for every row.

    A null or empty text, or one of white space only, has probability 0 and is not kept. Where no network can be
    fitted the probability is null and every text with a token is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, keep = _probabilities(shared.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(p, from_pandas=True), pa.array(keep)], ["doc_id", "probability", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, probability double, keep boolean")


def of_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_probabilities(shared.value, b.column(text))[1]))

    return passed(docs, run)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, probability)`` of the documents that are kept."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return classify(docs, labels).where("keep").select("doc_id", "probability")
