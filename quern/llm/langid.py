"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every text is lower-cased and cut into all its n-grams of 1 to 3 code points;
each falls into one of 2^16 buckets. Training counts buckets per declared
language over all documents. The matrix of log probabilities has one row per
bucket and one column per language, a size that does not grow with the data,
and is broadcast. A batch is scored as a sparse product: the rows of the
occurring buckets are gathered and summed per document.

A document is rejected if it holds no letter, or if the best language beats the
declared one by more than ``MARGIN`` nats (a text too short to tell keeps the
benefit of the doubt). Without a declared language it is rejected only for
want of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.text import chunks, passed, tables
from quern.storage import table

BUCKETS = 1 << 16
SMOOTHING = 1.0
MARGIN = 12.0
LANGUAGES = 400  #: most languages that a table may declare; the matrix takes 0.5 MB for each
_MULT = (1, 31_337, 982_451_653)  # of the first, second and third code point
_SHIFT = (0, 7, 15_485_863)  # of the orders


def gram_buckets(cp: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each code point; BUCKETS where a row ends before."""
    low = tables()[0][cp].astype(np.int64)
    n = len(low)
    for order in range(1, 4):
        h = low * _MULT[0]
        for k in range(1, order):
            h[: n - k] += low[k:] * _MULT[k]
        out = (h + _SHIFT[order - 1]) % 65_521
        for k in range(1, order):
            at = off[1:] - k
            out[at[at >= 0]] = BUCKETS
        yield out


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(languages, log probabilities (BUCKETS + 1, languages), log priors)`` from all documents with a declared language. The last row is zero and stands for no n-gram."""
    names = sorted(r[0] for r in docs.where("lang is not null").groupBy("lang").count().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"the column lang holds {len(names)} or more different values, above {LANGUAGES}: is it one of languages?")
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS + 1), np.int64)
        rows = np.zeros(len(names), np.int64)
        for b in batches:
            lang = np.array([place.get(x, -1) for x in b.column("lang").to_pylist()], np.int64)
            rows += np.bincount(lang[lang >= 0], minlength=len(names))
            for lo, hi, cp, off in chunks(b.column("text")):
                of_char = np.repeat(lang[lo:hi], np.diff(off))
                known = np.flatnonzero(of_char >= 0)
                base = of_char[known] * (BUCKETS + 1)
                for h in gram_buckets(cp, off):
                    total += np.bincount(base + h[known], minlength=total.size).reshape(total.shape)
        for i in range(len(names)):
            at = np.flatnonzero(total[i, :BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, i)), pa.array(np.append(at, -1)), pa.array(np.append(total[i, at], rows[i]))], ["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(names)))
    priors = np.zeros(len(names))
    if names:
        table = docs.select("lang", "text").mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        lang, bucket, n = (table[c].to_numpy() for c in ("lang", "bucket", "n"))
        counts[bucket[bucket >= 0], lang[bucket >= 0]] = n[bucket >= 0]
        priors[lang[bucket < 0]] = n[bucket < 0]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return names, np.vstack([logs, np.zeros((1, len(names)))]), np.log(np.maximum(priors, 1) / max(priors.sum(), 1))


def score(cp: np.ndarray, off: np.ndarray, logs: np.ndarray, priors: np.ndarray) -> np.ndarray:
    """(rows, languages): log joint probability of each row of a chunk."""
    rows = len(off) - 1
    out = np.tile(priors, (rows, 1))
    full = np.flatnonzero(np.diff(off))
    if len(full):
        grams = list(gram_buckets(cp, off))
        for j in range(len(priors)):
            column = np.ascontiguousarray(logs[:, j])
            at = column[grams[0]]
            for h in grams[1:]:
                at += column[h]
            out[full, j] += np.add.reduceat(at, off[:-1][full])
    return out


def _judged(model: tuple[list[str], np.ndarray, np.ndarray], text: pa.Array, lang: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    names, logs, priors = model
    word = tables()[1]
    n = len(text)
    best, margin, keep = [None] * n, np.zeros(n), np.zeros(n, bool)
    place = {x: i for i, x in enumerate(names)}
    declared = lang.to_pylist()
    for lo, hi, cp, off in chunks(text):
        letters = np.concatenate([[0], np.cumsum(word[cp])])[off]
        has = np.diff(letters) > 0
        if not names:
            keep[lo:hi] = has
            continue
        s = score(cp, off, logs, priors)
        top = s.argmax(axis=1)
        for r in np.flatnonzero(has):
            best[lo + r] = names[top[r]]
            own = place.get(declared[lo + r])
            margin[lo + r] = s[r, top[r]] - s[r, own] if own is not None else 0.0
        keep[lo:hi] = has & (margin[lo:hi] <= MARGIN)
    return best, margin, keep


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, language, margin, keep)`` for every row. ``language`` is null where a text holds no letter, digit or underscore (null and empty texts too), and such rows are not kept; ``margin`` is 0 where the declared language is the best, null or unknown to the model. Of languages that score alike the first by name is the best. doc_id is passed through, null or repeated; texts are scored whole, equal ones alike. A table that declares more than ``LANGUAGES`` values raises ValueError."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, margin, keep = _judged(shared.value, b.column("text"), b.column("lang"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(best, pa.string()), pa.array(margin), pa.array(keep)], ["doc_id", "language", "margin", "keep"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, language string, margin double, keep boolean")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judged(shared.value, b.column(text), b.column(lang))[2]))

    return passed(docs, run)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, language)`` of the documents that are kept."""
    return identify(table(spark, sf_dir, "documents")).where("keep").select("doc_id", "language")


#: The same in DuckDB. Text is cut by code point; 'margin' compares the best language with the declared one.
SQL = f"""
WITH chars AS (
  SELECT doc_id, lang, n, list_transform(regexp_extract_all(lower(text), '(?s).'), lambda c: unicode(c)::BIGINT) AS cs
  FROM (SELECT *, row_number() OVER () AS n FROM documents WHERE text <> '')
), grams AS (
  SELECT n, lang, unnest(list_concat(
    list_transform(cs, lambda c: c % 65521),
    list_transform(range(1, len(cs)), lambda i: (cs[i] + cs[i + 1] * {_MULT[1]} + {_SHIFT[1]}) % 65521),
    list_transform(range(1, len(cs) - 1), lambda i: (cs[i] + cs[i + 1] * {_MULT[1]} + cs[i + 2] * {_MULT[2]} + {_SHIFT[2]}) % 65521))) AS bucket
  FROM chars
), per_doc AS (SELECT n, lang, bucket, count(*) AS k FROM grams GROUP BY ALL),
langs AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang),
counted AS (SELECT lang, bucket, sum(k) AS k FROM per_doc WHERE lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(k) AS k FROM counted GROUP BY lang),
base AS (SELECT l.lang, ln(l.docs / (SELECT sum(docs) FROM langs)) AS prior, ln({SMOOTHING}) - ln(coalesce(t.k, 0) + {SMOOTHING} * {BUCKETS}) AS floor FROM langs l LEFT JOIN totals t USING (lang)),
scored AS (
  SELECT d.n, b.lang AS l, any_value(b.prior) + sum(d.k) * any_value(b.floor) + coalesce(sum(d.k * (ln(c.k + {SMOOTHING}) - ln({SMOOTHING}))), 0) AS s
  FROM per_doc d CROSS JOIN base b LEFT JOIN counted c ON c.lang = b.lang AND c.bucket = d.bucket GROUP BY d.n, b.lang
), best AS (SELECT n, max(s) AS s, arg_max(l, s) AS language FROM scored GROUP BY n)
SELECT c.doc_id, b.language
FROM (SELECT n, doc_id, lang FROM chars WHERE len(list_filter(cs, lambda x: regexp_matches(chr(x::INT), '[\\p{{L}}\\p{{N}}_]'))) > 0) c JOIN best b USING (n) LEFT JOIN scored o ON o.n = c.n AND o.l = c.lang
WHERE b.s - coalesce(o.s, b.s) <= {MARGIN}
"""
