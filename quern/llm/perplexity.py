"""Perplexity filter: a modified Kneser-Ney model of code point 5-grams, counted by Spark, held in sorted hash arrays.

A text is lower-cased, runs of white space become one blank and digits become
0; each code point then takes one of 4,096 symbols (code points from 2,048 on
share 2,047 of them by hash), so an n-gram is a 60-bit key whose context and
suffix are bit shifts away. A text is preceded by four start symbols.

Counting: every task counts the 5-grams of its documents, and how many
documents hold each, and sends sorted arrays of keys and counts, cut by a hash
of the middle three symbols. What is shuffled therefore grows with the corpus.
Lower orders hold continuation counts (distinct symbols before), which follow
from the distinct 5-grams. The three discounts of each order and language come
from the counts of counts of all documents.

A document must not vouch for itself: a 5-gram that one document alone holds
is pruned; a lower n-gram stays if a longer one that ends with it stays or if
two different ones do. The mass of pruned n-grams goes to the back-off weight.
Nothing else is pruned, however large the model grows.

The model is a sorted array of keys per language and order, with log
probabilities and back-off weights beside it, 12 bytes an n-gram. It is
broadcast in slices of about ``ENTRIES`` n-grams, at most 150 MB each and as
much again for the weights in the worst case, and looked up by binary search. A
slice holds whole languages, or of a larger one the n-grams whose contexts, read
from their last symbol, lie in a range, and those of all ends of such contexts,
to which they back off. Each 5-gram is therefore scored by one slice alone, with
the same result as by the whole model. Tasks read one slice after another.

Bands: ``z`` is a document's mean negative log probability less the median of its
language, allowing for length as for a mean, in spreads of that language: one
spread below the median and another above it, each from the documents on that
side, as the distributions are skewed. Medians and spreads come from histograms
of all documents. A document outside ``-LOWER .. UPPER`` spreads is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.text import chunks, mix, tables
from quern.storage import dropped, table, written

ORDER, BITS = 5, 12
SYMBOLS, START = 1 << BITS, (1 << BITS) - 1
LOWER, UPPER = 6.0, 8.0  #: band of each language, in its own lower and upper spreads from its median
HALF = 400  #: code points at which the spread is sqrt(2) times that of a long text
STEP = 1e-3  #: bin of the histograms
LEAST_SPREAD = 0.01
ENTRIES = 12_000_000  #: n-grams that a slice of the model may hold
_CONTEXTS = 1 << BITS * (ORDER - 1)
_HELD = 1 << 22


def _mask(order: int) -> int:
    return (1 << BITS * order) - 1


_SYMBOL: list[np.ndarray] = []


def symbols(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a chunk and their offsets; white space at the ends of a text is kept as one blank."""
    if not _SYMBOL:
        low = tables()[0].astype(np.int64)
        table = np.where(low < 2048, low, 2048 + low % 2039)
        white = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[white] = 32
        table[0x30:0x3A] = 0x30
        _SYMBOL.append(table.astype(np.int64))
    s = _SYMBOL[0][cp]
    blank = s == 32
    drop = np.zeros(len(s), bool)
    drop[1:] = blank[1:] & blank[:-1]
    inner = off[1:-1]
    drop[inner[inner < len(s)]] = False
    ends = np.concatenate([[0], np.cumsum(~drop)])
    return s[~drop], ends[off]


def keys_of(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each symbol of a chunk, and the offsets of the rows in them."""
    s, o = symbols(cp, off)
    rows = len(o) - 1
    padded = np.full(len(s) + (ORDER - 1) * rows, START, np.int64)
    at = np.arange(len(s)) + (ORDER - 1) * (np.repeat(np.arange(rows), np.diff(o)) + 1)
    padded[at] = s
    key = np.zeros(len(s), np.int64)
    for k in range(ORDER):
        key = key << BITS | padded[at - (ORDER - 1) + k]
    return key, o


def document_counts(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, distinct 5-grams, counts)`` of every row that has any."""
    for lo, hi, cp, off in chunks(text):
        key, o = keys_of(cp, off)
        for r in range(hi - lo):
            if o[r + 1] > o[r]:
                yield lo + r, *np.unique(key[o[r] : o[r + 1]], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n, df = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n[order], first), np.add.reduceat(df[order], first)


class _Counter:
    """5-grams with counts and numbers of documents, by name; summed whenever much has gathered."""

    def __init__(self):
        self.parts: dict = {}
        self.held: dict = {}

    def add(self, name, key: np.ndarray, n: np.ndarray, df: np.ndarray) -> None:
        parts = self.parts.setdefault(name, [])
        parts.append((key, n, df))
        self.held[name] = self.held.get(name, 0) + len(key)
        if self.held[name] > _HELD + 2 * len(parts[0][0]):
            self.parts[name] = [_summed(parts)]
            self.held[name] = 0

    def totals(self) -> Iterator[tuple]:
        for name, parts in self.parts.items():
            yield name, *_summed(parts)


def count_grams(docs: DataFrame) -> DataFrame:
    """``(lang, g, a, df)``: every distinct 5-gram, its count and the number of document rows that hold it, written to the shared folder. A null language counts as ''."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for b in batches:
            lang = b.column("lang").to_pylist()
            for r, key, n in document_counts(b.column("text")):
                counter.add(lang[r], key, n, np.ones(len(key), np.int64))
        for lang, key, n, df in counter.totals():
            part = (mix((key >> BITS & _mask(3)).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part).tolist():
                mine = part == p
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([p]), *(pa.array([np.diff(x[mine], prepend=0).astype(kind).tobytes()], pa.binary()) for x, kind in ((key, np.int64), (n, np.int32 if n.max() < 2**31 else np.int64), (df, np.int32 if n.max() < 2**31 else np.int64)))], ["lang", "part", "g", "a", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for b in batches:
            for lang, g, a, df in zip(*(b.column(c).to_pylist() for c in ("lang", "g", "a", "df"))):
                key = np.cumsum(np.frombuffer(g, np.int64))
                counter.add(lang, key, *(np.cumsum(np.frombuffer(x, np.int32 if len(x) == 4 * len(key) else np.int64), dtype=np.int64) for x in (a, df)))
        for lang, key, n, df in counter.totals():
            for k in range(0, len(key), 1 << 18):
                s = slice(k, k + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key[s]), pa.string()), pa.array(key[s]), pa.array(n[s]), pa.array(df[s])], ["lang", "g", "a", "df"])

    blocks = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text").mapInArrow(count, "lang string, part long, g binary, a binary, df binary")
    return written(blocks.repartition(parts, "part").mapInArrow(add, "lang string, g long, a long, df long"), "grams")


def _suffix(order: int, g: str | Column = "g") -> Column:
    return (F.col(g) if isinstance(g, str) else g).bitwiseAND(F.lit(_mask(order)))


def _prefix(g: str = "g") -> Column:
    return F.shiftright(F.col(g), BITS)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams counted once to four times; 1/2, 1 and 3/2 where these don't give discounts within (0, count)."""
    n1, n2, n3, n4 = n
    if min(n) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def orders(grams: DataFrame) -> DataFrame:
    """``(lang, k, g, a, level)`` of every n-gram of every order: its count (of distinct symbols before it, below the highest order) and the most documents, or distinct longer n-grams, that it may be asked to have and still stay."""
    rows = grams.select("lang", F.lit(ORDER).cast("byte").alias("k"), "g", "a", F.col("df").alias("level"))
    found = [rows]
    for k in range(ORDER - 1, 0, -1):
        n = F.count("*")
        rows = rows.groupBy("lang", _suffix(k).alias("g")).agg(n.alias("a"), F.greatest(F.max("level"), n).alias("level")).select("lang", F.lit(k).cast("byte").alias("k"), "g", "a", "level")
        found.append(rows)
    while len(found) > 1:
        found[0] = found[0].union(found.pop())
    return written(found[0], "orders", [grams])


def least_level(every: DataFrame, kept: int, entries: int) -> int:
    """The least level, from 2, from which at most so many n-grams (``kept`` of which have level 2) have."""
    if kept <= entries:
        return 2
    sizes = every.where("level > 1").groupBy(F.floor(F.log2("level") * 8).alias("bin")).agg(F.count("*").alias("n"), F.max("level").alias("top")).orderBy("bin").collect()
    for row in sizes:  # some hundred bins at most
        kept -= row["n"]
        if kept <= entries:
            return row["top"] + 1
    return 2


def interpolated(every: DataFrame, entries: int | None = None) -> DataFrame:
    """``(lang, k, g, alpha, gamma)`` of the n-grams that stay: discounted relative frequency after their context, and the part of the context's mass that is left to the lower order. A smaller model of so many ``entries`` can be asked for; scoring never does."""
    spark = every.sparkSession
    a = F.col("a")
    found = every.groupBy("lang", "k").agg(*(F.count_if(a == i).alias(f"n{i}") for i in range(1, 5)), F.count_if(F.col("level") > 1).alias("kept")).collect()
    least = 2 if entries is None else least_level(every, sum(r["kept"] for r in found), entries)
    table = spark.createDataFrame([(r["lang"], r["k"], *discounts([r[f"n{i}"] for i in range(1, 5)])) for r in found], "lang string, k byte, d1 double, d2 double, d3 double")
    own = a - F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
    stays = F.col("level") >= least
    context = Window.partitionBy("lang", "k", "context")  # holds at most an n-gram for each symbol
    rows = every.join(F.broadcast(table), ["lang", "k"]).select("lang", "k", "g", stays.alias("stays"), own.alias("own"), "a", _prefix().alias("context"))
    total, mass = F.sum("a").over(context), F.sum(F.when(F.col("stays"), F.col("own")).otherwise(0.0)).over(context)
    whole = rows.select("lang", "k", "g", "stays", (F.col("own") / total).alias("alpha"), F.greatest(1 - mass / total, F.lit(1e-12)).alias("gamma"))
    return whole.where("stays").select("lang", "k", "g", "alpha", "gamma")


def _backwards(g: np.ndarray) -> np.ndarray:
    """The contexts of 5-grams read from their last symbol, as numbers."""
    out = np.zeros(len(g), np.int64)
    for _ in range(ORDER - 1):
        g = g >> BITS
        out = out << BITS | g & _mask(1)
    return out


def _span() -> tuple[Column, Column]:
    """Of an n-gram of any order: the first, and the number, of the contexts of 5-grams (as :func:`_backwards` reads them) that end with its own."""
    first = F.lit(0).cast("long")
    for j in range(1, ORDER):
        first = first.bitwiseOR(F.shiftleft(F.shiftright("g", BITS * j).bitwiseAND(F.lit(_mask(1))), BITS * (ORDER - 1 - j)))
    return first, F.expr(f"shiftleft(1L, {BITS} * ({ORDER} - k))")


def slices(rows: DataFrame, entries: int) -> list[tuple[frozenset, int, int, DataFrame]]:
    """``(languages, first, end, rows)`` of parts of a model of about so many n-grams at most: all that 5-grams of these languages with contexts of that range need."""
    sizes = sorted(tuple(r) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if sum(n for _, n in sizes) <= entries:
        return [(frozenset(x for x, _ in sizes), 0, _CONTEXTS, rows)]
    first, many = _span()
    out, held, size = [], [], 0

    def close() -> None:
        if held:
            out.append((frozenset(held), 0, _CONTEXTS, rows.where(F.col("lang").isin(held))))

    for lang, n in sizes:
        own = rows.where(F.col("lang") == lang)
        if n > entries:
            parts = -(-5 * n // (4 * entries))  # a quarter more, as the quantiles are approximate
            cuts = own.select(F.percentile_approx(first, [i / parts for i in range(1, parts)], min(20 * parts, 1 << 20))).first()[0]
            ends = sorted({0, _CONTEXTS, *cuts})
            out += [(frozenset([lang]), lo, hi, own.where((first < hi) & (first + many > lo))) for lo, hi in zip(ends, ends[1:])]
            continue
        if size + n > entries:
            close()
            held, size = [], 0
        held.append(lang)
        size += n
    close()
    return out


class Model:
    """Sorted arrays: ``p[lang, k]`` and ``b[lang, k]`` are ``(keys, values)``, log probabilities of n-grams of k symbols and log weights of contexts of k (a context without one backs off with all its mass)."""

    def __init__(self, rows: DataFrame):
        t = rows.select("lang", "k", "g", F.col("alpha").cast("float"), F.col("gamma").cast("float")).toArrow().sort_by([("lang", "ascending"), ("k", "ascending"), ("g", "ascending")])
        k, g, alpha, gamma = (t[c].to_numpy() for c in ("k", "g", "alpha", "gamma"))
        names = t["lang"].combine_chunks().dictionary_encode()
        code = names.indices.to_numpy().astype(np.int64) * (ORDER + 1) + k
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.p, self.b = {}, {}
        for lo, hi in zip(first, [*first[1:], len(code)]):  # in order of k within a language
            lang, order = names.dictionary[int(code[lo]) // (ORDER + 1)].as_py(), int(k[lo])
            keys, left = g[lo:hi], gamma[lo:hi].astype(np.float64)
            lower = 1 / SYMBOLS
            if order > 1:
                below, logs = self.p[lang, order - 1]
                lower = np.exp(logs[np.searchsorted(below, keys & _mask(order - 1))].astype(np.float64))
            self.p[lang, order] = keys, np.log(alpha[lo:hi] + left * lower).astype(np.float32)
            context, at = np.unique(keys >> BITS, return_index=True)
            self.b[lang, order - 1] = context, np.log(left[at]).astype(np.float32)

    @staticmethod
    def _find(arrays: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if arrays is None or not len(arrays[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(arrays[0], keys), len(arrays[0]) - 1)
        return arrays[0][at] == keys, arrays[1][at]

    def logp(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each 5-gram (sorted keys are found fastest)."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            g = keys[open_] & _mask(k)
            found, value = self._find(self.p.get((lang, k)), g)
            out[open_[found]] += value[found]
            open_, g = open_[~found], g[~found]
            if not len(open_):
                return out
            less, value = self._find(self.b.get((lang, k - 1)), g >> BITS)
            out[open_[less]] += value[less]
        out[open_] -= np.log(SYMBOLS)
        return out


_SCORES = "doc_id long, lang string, n long, nll double"


def _scored(docs: DataFrame, models: list[tuple[frozenset, int, int, Broadcast]]) -> DataFrame:
    most = 1 << (20 if len(models) == 1 else 21)  # 5-grams that are scored together

    def model_of(shared: Broadcast) -> Model:
        path = getattr(shared, "_path", None)
        return shared.load_from_path(path) if path and len(models) > 1 else shared.value  # of several, one is held at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = [x or "" for x in b.column("lang").to_pylist()]
            n, nll = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.nan)
            held: dict[str, list] = {}
            size = 0

            def flush() -> None:
                grams = {name: np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True) for name, rows in held.items()}
                scored = {name: np.full(len(distinct), -np.log(SYMBOLS)) for name, (distinct, _) in grams.items()}
                for names, lo, hi, shared in models:
                    mine = names & grams.keys()
                    model = model_of(shared) if mine else None
                    for name in mine:
                        distinct, at = grams[name][0], slice(None)
                        if hi - lo < _CONTEXTS:
                            context = _backwards(distinct)
                            at = np.flatnonzero((context >= lo) & (context < hi))
                        scored[name][at] = model.logp(name, distinct[at])
                    del model
                for name, rows in held.items():
                    p = scored[name][grams[name][1]]
                    first = np.cumsum([0, *(len(k) for _, k, _ in rows[:-1])])
                    total = np.add.reduceat(p * np.concatenate([c for _, _, c in rows]), first)
                    for (r, _, c), t in zip(rows, total):
                        n[r] = c.sum()
                        nll[r] = -t / n[r]
                held.clear()

            for r, key, c in document_counts(b.column("text")):
                held.setdefault(lang[r], []).append((r, key, c))
                size += len(key)
                if size > most:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("lang").cast(pa.string()), pa.array(n), pa.array(nll, from_pandas=True)], ["doc_id", "lang", "n", "nll"])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, _SCORES)


def scores(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """``(doc_id, lang, n, nll)`` per row: symbols and mean negative log probability in nats (null for a text without code points), under the model of all rows of the same language. ``entries``, the size of its slices, doesn't change the scores."""
    every = orders(count_grams(docs))
    rows = written(interpolated(every), "model", [every])
    share = docs.sparkSession.sparkContext.broadcast
    models = [(*what, share(Model(part))) for *what, part in slices(rows, entries)]
    dropped(rows)
    return _scored(docs, models)


def _medians(rows: DataFrame, value: Column, *by: str) -> dict[tuple, float]:
    """Median of a value in every group, from a histogram."""
    bins = rows.groupBy(*by, F.floor(value / STEP).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").toArrow().to_pylist()
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for r in bins:
        groups.setdefault(tuple(r[c] for c in by), []).append((r["bin"], r["n"]))
    out = {}
    for name, found in groups.items():
        total = np.cumsum([n for _, n in found])
        out[name] = (found[int(np.searchsorted(total * 2, total[-1]))][0] + 0.5) * STEP
    return out


def _per_language(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in (values or {"": 0.0}).items() for x in kv))[F.coalesce("lang", F.lit(""))]


def _with_bands(scored: DataFrame) -> DataFrame:
    """Adds ``z``: distance from the language's median in its lower or upper spreads, which allow for length."""
    known = scored.where("nll is not null").withColumn("name", F.coalesce("lang", F.lit("")))
    middle = _per_language({k: v for (k,), v in _medians(known, F.col("nll"), "name").items()})
    off = (F.col("nll") - middle) / F.sqrt(1 + HALF / F.nullif(F.col("n"), F.lit(0)))
    sides = _medians(known.withColumns({"below": off < 0, "off": F.abs(off)}), F.col("off"), "name", "below")
    spread = {below: _per_language({k: max(v / 0.6745, LEAST_SPREAD) for (k, side), v in sides.items() if side is below}) for below in (True, False)}
    return scored.withColumn("z", F.when(off < 0, off / spread[True]).otherwise(off / spread[False]))


def judge(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, entries: int = ENTRIES) -> DataFrame:
    """``(doc_id, lang, perplexity, z, keep)`` for every row.

    A null or empty text has null perplexity and z and is not kept. Rows without a language are judged among
    themselves. A null or repeated doc_id is passed through; repeated texts count each, equal ones are judged
    alike. Texts are scored whole, however long. An empty table gives an empty one.
    """
    scored = _with_bands(written(scores(docs, entries), "scores"))
    return scored.select("doc_id", "lang", F.exp("nll").alias("perplexity"), "z", F.coalesce(F.col("z").between(-lower, upper), F.lit(False)).alias("keep"))


def op1_ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, perplexity)`` of the documents within their language's band."""
    return judge(table(spark, sf_dir, "documents")).where("keep").select("doc_id", "lang", "perplexity")
