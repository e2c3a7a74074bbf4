"""Queries over the test tables, one per operator, with DuckDB SQL of the same rows where SQL can express them.

No SQL engine has XXH64, so the MinHash queries with SQL take the portable
shingle identities (60 bits of MD5); those named ``*_xxhash`` run the default
family and are held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import PipelineConfig
from quern.functions import text as T
from quern.functions.hashing import EMPTY, PRIME, BandingScheme, bloom_sizing, coefficients, factorizations, recall_ceiling, recommend_bands
from quern.operators import clusters as C
from quern.operators import evaluate as E
from quern.operators import lsh
from quern.operators import passages as P
from quern.operators import similarity as S
from quern.operators.minhash import MinHasher
from quern.operators.simhash64 import hamming_pairs, simhash64
from quern.plans.pipeline import DedupPipeline
from quern.sources.readers import ID, read_documents
from quern.sources.writers import stats_path
from quern.storage import shared_path, small_batches, written
from quern.storage import table as stored
from quern.streaming.incremental import deduplicate_stream

K, FUNCTIONS, BANDS, ROWS, THRESHOLD = 3, 16, 4, 4, 0.7
STOPWORDS = ["the", "of", "and", "de", "la", "le", "der", "die", "und", "el", "que", "en"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- SQL shared by the oracles --------------------------------------------------------------------------------
_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
_WORD = r"[\p{L}\p{N}_]+"


def _norm(column: str = "text") -> str:
    return f"trim(regexp_replace(lower({column}), '{_WHITE}+', ' ', 'g'))"


def _docs(table: str = "documents", key: str = "doc_id") -> str:
    return f"docs AS (SELECT {key} AS d, {_norm()} AS t FROM {table})"


def _grams(tokens: str, k: int) -> str:
    """List of n-grams of a list expression."""
    return f"CASE WHEN len({tokens}) >= {k} THEN list_transform(range(1, len({tokens}) - {k} + 2), lambda i: array_to_string(({tokens})[i:i + {k - 1}], chr(31))) WHEN len({tokens}) > 0 THEN [array_to_string({tokens}, chr(31))] ELSE [] END"


def _sets(table: str = "documents", key: str = "doc_id", name: str = "") -> str:
    return f"""{name}docs AS (SELECT {key} AS d, {_norm()} AS t FROM {table}),
{name}words AS (SELECT d, regexp_extract_all(t, '{_WORD}') AS w FROM {name}docs),
{name}sets AS (SELECT d, list_distinct(list_transform({_grams("w", K)}, lambda g: ('0x' || substr(md5(g), 1, 15))::BIGINT)) AS s FROM {name}words)"""


def _signatures(name: str = "", **kw: str) -> str:
    a, b = coefficients(FUNCTIONS)
    mins = ", ".join(f"coalesce(min((({int(p) >> 16}::BIGINT * x) % {PRIME} * 65536 + {int(p) & 65535}::BIGINT * x + {int(q)}) % {PRIME}), {EMPTY})" for p, q in zip(a, b))
    return f"""{_sets(name=name, **kw)},
{name}items AS (SELECT d, unnest(s) % {PRIME} AS x FROM {name}sets),
{name}sigs AS (SELECT d, [{mins}] AS sig FROM {name}docs LEFT JOIN {name}items USING (d) GROUP BY d)"""


def _keys(name: str = "") -> str:
    return f"{name}keys AS (SELECT d, band, sig[band * {ROWS} + 1:(band + 1) * {ROWS}] AS key FROM {name}sigs CROSS JOIN (SELECT unnest(range({BANDS})) AS band))"


_PAIRS = f"{_signatures()}, {_keys()}, pairs AS (SELECT DISTINCT l.d AS i, r.d AS j FROM keys l JOIN keys r ON l.band = r.band AND l.key = r.key AND l.d < r.d)"
_CLUSTERS = f"""{_PAIRS}, links AS (SELECT i AS a, j AS b FROM pairs UNION SELECT j, i FROM pairs),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
clusters AS (SELECT least(a, min(b)) AS c, a AS d FROM reach GROUP BY a)"""
_TRUTH = f"""truth AS (SELECT i, j, n / (x.m + y.m - n) AS jaccard FROM (
  SELECT a.d AS i, b.d AS j, count(*) AS n FROM (SELECT d, unnest(s) AS h FROM sets) a JOIN (SELECT d, unnest(s) AS h FROM sets) b ON a.h = b.h AND a.d < b.d GROUP BY ALL) p
  JOIN (SELECT d, len(s) AS m FROM sets) x ON x.d = i JOIN (SELECT d, len(s) AS m FROM sets) y ON y.d = j WHERE n / (x.m + y.m - n) >= {THRESHOLD})"""


# --- tables shared by the queries -----------------------------------------------------------------------------
def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    small_batches(spark)
    return stored(spark, sf, table)


def _documents(spark: SparkSession, sf: str, table: str = "documents", key: str = "doc_id") -> DataFrame:
    return _read(spark, sf, table).select(F.col(key).alias("doc_idx"), T.normalize(F.col("text")).alias("norm_text"))


def _portable_sets(docs: DataFrame) -> DataFrame:
    return docs.select("doc_idx", T.portable_word_shingles(F.col("norm_text"), K).alias("shingles"))


def _portable_signatures(docs: DataFrame) -> DataFrame:
    return MinHasher(FUNCTIONS).signatures(_portable_sets(docs))


def _portable_keys(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.band_keys(written(_portable_signatures(_documents(spark, sf)), "signatures"), BANDS, ROWS)


def _portable_clusters(spark: SparkSession, sf: str) -> DataFrame:
    distinct, copies = lsh.collapsed(written(_portable_signatures(_documents(spark, sf)), "signatures"))
    return written(C.duplicate_clusters(copies.union(lsh.connecting_edges(lsh.band_keys(distinct, BANDS, ROWS)))), "clusters")


# --- statistics and exact duplicates --------------------------------------------------------------------------
@_query("SELECT count(*) AS documents, avg(length(text)) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length, count(*) - count(DISTINCT text) AS exact_duplicates FROM documents WHERE text IS NOT NULL")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.corpus_statistics(_read(spark, sf, "documents"))


@_query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce({_norm()}, '')")
def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return S.exact_groups(_read(spark, sf, "documents"), T.normalize(F.col("text")))


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup_keep(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return docs.join(S.exact_groups(docs).select("doc_id"), "doc_id", "left_semi")


# --- text -----------------------------------------------------------------------------------------------------
@_query(f"SELECT doc_id, {_norm()} AS norm_text FROM documents")
def normalize_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm_text"))


@_query()
def normalize_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "pages").select("page_id", T.normalize(F.col("html")).alias("norm_text"))


@_query(f"SELECT doc_id, coalesce(length(regexp_replace(text, '[^{_CJK[1:]}', '', 'g')) / nullif(length(regexp_replace(text, '{_WHITE}', '', 'g')), 0), 0) AS ratio, ratio >= 0.2 AS is_cjk FROM documents")
def cjk_ratio_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", T.cjk_ratio(F.col("text")).alias("ratio"), T.is_cjk(F.col("text")).alias("is_cjk"))


@_query(f"WITH {_docs()} SELECT d AS doc_id, len(regexp_extract_all(t, '{_WORD}')) AS n_words FROM docs")
def word_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), F.size(T.word_tokens(F.col("norm_text"))).cast("long").alias("n_words"))


@_query(f"WITH {_docs()}, tok AS (SELECT d, regexp_extract_all(t, '{_WORD}') AS w FROM docs), g AS (SELECT d, {_grams('w', K)} AS g FROM tok) SELECT d AS doc_id, len(g) AS n_grams, len(list_distinct(g)) AS n_shingles FROM g")
def word_shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), T.word_gram_counts(F.col("norm_text"), K, 0.2).alias("c"))
    return counted.select("doc_id", F.col("c.grams").alias("n_grams"), F.col("c.kinds").alias("n_shingles"))


@_query(f"WITH {_docs()}, n AS (SELECT d, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM docs WHERE t <> ''), c AS (SELECT d, count(*) AS n_grams, count(DISTINCT substr(t, i, 5)) AS n_shingles FROM n GROUP BY d) SELECT d AS doc_id, coalesce(n_grams, 0) AS n_grams, coalesce(n_shingles, 0) AS n_shingles FROM docs LEFT JOIN c USING (d)")
def char_shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    grams, kinds = T.char_gram_counts(F.col("norm_text"), 5)
    return _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), grams.alias("n_grams"), kinds.alias("n_shingles"))


@_query(f"WITH {_docs()}, s AS (SELECT d, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM docs) SELECT d AS doc_id, len(s) AS n_sentences, len(list_distinct(s)) AS n_distinct FROM s")
def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentence_tokens(F.col("norm_text"))
    return _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), F.size(s).cast("long").alias("n_sentences"), F.size(F.array_distinct(s)).cast("long").alias("n_distinct"))


@_query(f"WITH {_docs()}, p AS (SELECT d, regexp_replace(regexp_replace(t, 'https?://[^ ]+', '<URL>', 'g'), '[0-9]+', '<NUM>', 'g') AS t FROM docs) SELECT d AS doc_id, len(list_filter(regexp_extract_all(t, '{_WORD}'), lambda w: w NOT IN ({', '.join(repr(w) for w in STOPWORDS)}))) AS n_words, md5(t) AS digest FROM p")
def placeholder_stopword_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = T.with_placeholders(F.col("norm_text"))
    return _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), F.size(T.without_words(T.word_tokens(t), STOPWORDS)).cast("long").alias("n_words"), F.md5(t).alias("digest"))


# --- signatures, buckets, pairs -------------------------------------------------------------------------------
@_query(f"WITH {_signatures()} SELECT d AS doc_id, array_to_string(sig, ',') AS signature FROM sigs")
def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return _portable_signatures(_documents(spark, sf)).select(F.col("doc_idx").alias("doc_id"), F.array_join("signature", ",").alias("signature"))


@_query(ORACLE_SQL["minhash_signatures"])
def minhash_by_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return MinHasher(FUNCTIONS).signatures_by_aggregation(_portable_sets(_documents(spark, sf))).select(F.col("doc_idx").alias("doc_id"), F.array_join("signature", ",").alias("signature"))


@_query()
def minhash_xxhash(spark: SparkSession, sf: str) -> DataFrame:
    p = DedupPipeline(PipelineConfig(), spark)
    return p.compute_signatures(p.shingle_batch(_documents(spark, sf)), origins=False)


@_query(f"WITH {_signatures()}, {_keys()} SELECT band::INT AS band, size, count(*) AS n_buckets FROM (SELECT band, key, count(*) AS size FROM keys GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL")
def lsh_band_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.buckets(_portable_keys(spark, sf)).groupBy("band", "size").agg(F.count("*").alias("n_buckets"))


@_query(f"WITH {_PAIRS} SELECT i, j FROM pairs")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return lsh.candidate_pairs(_portable_keys(spark, sf))


@_query(f"WITH {_PAIRS} SELECT i, j, len(list_filter(list_zip(a.sig, b.sig), lambda x: x[1] = x[2])) / {FUNCTIONS} AS estimate FROM pairs JOIN sigs a ON a.d = i JOIN sigs b ON b.d = j WHERE estimate >= {THRESHOLD}")
def verified_pairs(spark: SparkSession, sf: str) -> DataFrame:
    signatures = written(_portable_signatures(_documents(spark, sf)), "signatures")
    return lsh.verified(lsh.candidate_pairs(lsh.band_keys(signatures, BANDS, ROWS)), signatures, THRESHOLD)


@_query(f"WITH {_sets()}, {_TRUTH} SELECT i, j, jaccard FROM truth")
def exact_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.exact_jaccard_pairs(written(_portable_sets(_documents(spark, sf)), "sets"), THRESHOLD, "doc_idx")


# --- clusters and output --------------------------------------------------------------------------------------
@_query(f"WITH RECURSIVE {_CLUSTERS} SELECT c AS cluster_id, d AS doc_idx FROM clusters")
def duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _portable_clusters(spark, sf)


@_query(f"WITH RECURSIVE {_CLUSTERS} SELECT size, count(*) AS n_clusters FROM (SELECT c, count(*) AS size FROM clusters GROUP BY c) GROUP BY size")
def cluster_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.size_histogram(_portable_clusters(spark, sf))


@_query(f"WITH RECURSIVE {_CLUSTERS} SELECT c AS cluster_id, d AS doc_idx FROM clusters JOIN docs USING (d) QUALIFY row_number() OVER (PARTITION BY c ORDER BY length(t) DESC, d) = 1")
def representatives_longest(spark: SparkSession, sf: str) -> DataFrame:
    return C.representatives(_portable_clusters(spark, sf), _documents(spark, sf).select("doc_idx", F.length("norm_text").alias("length")))


@_query(f"WITH RECURSIVE {_CLUSTERS} SELECT c AS cluster_id, min(d) AS doc_idx FROM clusters GROUP BY c")
def representatives_first(spark: SparkSession, sf: str) -> DataFrame:
    return C.representatives(_portable_clusters(spark, sf), strategy="first")


_KEPT = f"WITH RECURSIVE {_CLUSTERS}, kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT d FROM clusters WHERE d <> c))"


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    clusters = _portable_clusters(spark, sf)
    docs = _read(spark, sf, "documents").withColumn("doc_idx", F.col("doc_id"))
    return C.survivors(docs, clusters, C.representatives(clusters, strategy="first")).drop("doc_idx")


@_query(f"{_KEPT} SELECT doc_id, text, lang, source, n_chars FROM kept")
def dedup_output(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf)


@_query(f"{_KEPT} SELECT n AS before, m AS after, (n - m) / n AS dedup_rate FROM (SELECT count(*) AS n FROM documents), (SELECT count(*) AS m FROM kept)")
def dedup_rate(spark: SparkSession, sf: str) -> DataFrame:
    before = _read(spark, sf, "documents").agg(F.count("*").alias("before"))
    after = _kept(spark, sf).agg(F.count("*").alias("after"))
    n, m = F.col("before"), F.col("after")
    return before.crossJoin(after).select("before", "after", F.when(n > 0, (n - m) / n).otherwise(0.0).alias("dedup_rate"))


@_query(f"{_KEPT} SELECT source, lang, n AS before, coalesce(m, 0) AS after, (n - coalesce(m, 0)) / n AS dedup_rate FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) LEFT JOIN (SELECT source, lang, count(*) AS m FROM kept GROUP BY ALL) USING (source, lang)")
def dedup_rate_by_source(spark: SparkSession, sf: str) -> DataFrame:
    before = _read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("before"))
    after = _kept(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("after"))
    n, m = F.col("before"), F.coalesce("after", F.lit(0))
    return before.join(after, ["source", "lang"], "left").select("source", "lang", "before", m.alias("after"), ((n - m) / n).alias("dedup_rate"))


@_query()
def dedup_default_config(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the default settings keep (5-grams of characters, 16 x 8 of XXH64, longest)."""
    p = DedupPipeline(PipelineConfig(), spark)
    docs = written(_documents(spark, sf), "documents")
    signatures = written(p.compute_signatures(p.shingle_batch(docs)), "signatures")
    clusters = written(p.cluster_duplicates(p.duplicate_edges(signatures)), "clusters")
    gone = C.dropped_ids(clusters, p.select_representatives(clusters, docs))
    raw = _read(spark, sf, "documents")
    return raw.join(gone, raw["doc_id"] == gone["doc_idx"], "left_anti")


_LENGTH = 8  # words of an n-gram that is evidence of a benchmark


def _long_grams(source: str, key: str, name: str) -> str:
    words = f"regexp_extract_all({_norm()}, '{_WORD}')"
    return f"{name} AS (SELECT k, unnest(list_distinct(g)) AS g, len(list_distinct(g)) AS n FROM (SELECT {key} AS k, {_grams('w', _LENGTH)} AS g FROM (SELECT {key}, {words} AS w FROM {source})))"


_SHARED = f"WITH {_long_grams('documents', 'doc_id', 'd')}, {_long_grams('benchmark', 'item_id', 'b')}"


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    grams = lambda: T.ngrams(T.word_tokens(F.col("norm_text")), _LENGTH)
    docs, items = _documents(spark, sf), _documents(spark, sf, "benchmark", "item_id")
    return P.shared_ngrams(docs.withColumnRenamed("doc_idx", "doc_id"), grams(), items.withColumnRenamed("doc_idx", "item_id"), grams())


@_query(f"{_SHARED} SELECT d.k AS doc_id, b.k AS item_id, count(*) AS shared, count(*) / any_value(b.n) AS part FROM d JOIN b USING (g) GROUP BY ALL")
def benchmark_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share 8-grams of words with benchmark items (a shorter item is one n-gram)."""
    return _shared(spark, sf)


@_query(f"{_SHARED} SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT d.k FROM d JOIN b USING (g))")
def train_minus_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share no passage of eight words with a benchmark item."""
    return _read(spark, sf, "documents").join(_shared(spark, sf).select("doc_id"), "doc_id", "left_anti")


@_query(f"""WITH {_docs()}, w AS (SELECT d, regexp_extract_all(t, '{_WORD}') AS w FROM docs), r AS (SELECT d, unnest(range(len(w) - 49)) AS p, w FROM w WHERE len(w) >= 50),
g AS (SELECT d, p, md5(array_to_string(w[p + 1:p + 50], chr(31))) AS g FROM r), f AS (SELECT d, p FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
b AS (SELECT d, p, CASE WHEN p - lag(p) OVER o <= 49 THEN 0 ELSE 1 END AS begins FROM f WINDOW o AS (PARTITION BY d ORDER BY p)), s AS (SELECT d, p, sum(begins) OVER (PARTITION BY d ORDER BY p) AS stretch FROM b)
SELECT d AS doc_id, min(p) AS start, max(p) - min(p) + 50 AS n_words FROM s GROUP BY d, stretch""")
def repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of 50 words or more that stand elsewhere too."""
    docs = _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), "norm_text")
    return P.repeated_passages(docs, T.word_tokens(F.col("norm_text")), 50)


_PRINTS = f"""{_docs()}, tok AS (SELECT d, unnest(regexp_extract_all(t, '{_WORD}')) AS w FROM docs), h AS (SELECT d, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM tok),
sums AS (SELECT d, {", ".join(f"2 * count_if((h >> {i}) & 1 = 1) > count(*) AS b{i}" for i in range(64))} FROM h GROUP BY d),
prints AS (SELECT d, {" + ".join(f"CASE WHEN b{i} THEN {1 << i}::UHUGEINT ELSE 0 END" for i in range(64))} AS f FROM sums)"""


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select(F.col("doc_idx").alias("doc_id"), simhash64(T.word_tokens(F.col("norm_text"))).alias("fingerprint"))


@_query(f"WITH {_PRINTS} SELECT docs.d AS doc_id, coalesce(prints.f, 0)::VARCHAR AS fingerprint FROM docs LEFT JOIN prints USING (d)")
def simhash_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprints(spark, sf).select("doc_id", F.conv(F.hex("fingerprint"), 16, 10).alias("fingerprint"))


@_query(f"WITH {_PRINTS}, c AS (SELECT min(d) AS d, f::UBIGINT AS f FROM prints GROUP BY f) SELECT a.d AS i, b.d AS j, bit_count(xor(a.f, b.f)::UBIGINT::BIT)::BIGINT AS distance FROM c a JOIN c b ON a.d < b.d WHERE distance <= 3")
def simhash_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct 64-bit fingerprints at most 3 bits apart, each named by its least document."""
    return hamming_pairs(written(_fingerprints(spark, sf), "fingerprints"), 3)


@_query(f"WITH {_sets()}, {_TRUTH}, c AS (SELECT list_sort(s) AS s, min(d) AS d FROM sets WHERE len(s) > 0 GROUP BY 1) SELECT i, j, jaccard FROM truth WHERE i IN (SELECT d FROM c) AND j IN (SELECT d FROM c) AND jaccard < 1")
def exact_jaccard_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct shingle sets, each named by the least document that has it."""
    return S.exact_jaccard_classes(_portable_sets(_documents(spark, sf)), THRESHOLD, "doc_idx")[0]


@_query(f"WITH RECURSIVE {_CLUSTERS} SELECT c AS cluster_id, count(*) AS size FROM clusters GROUP BY c HAVING count(*) > 5")
def giant_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return C.giant_clusters(_portable_clusters(spark, sf), 5)


# --- sources, sinks and whole runs ----------------------------------------------------------------------------
_ALL = "SELECT doc_id, text, lang, source, n_chars FROM documents"


def _as_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    found = read_documents(spark, path, "text", key)
    return found.select(F.col(ID).alias("doc_id"), "text", "lang", "source", "n_chars")


def _stored(spark: SparkSession, sf: str, kind: str) -> str:
    folder = shared_path(spark, "source")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if kind == "parquet":
        docs.write.parquet(f"{folder}/documents.parquet")
    else:
        docs.write.option("compression", "gzip" if kind == "jsonl.gz" else "none").json(f"{folder}/documents.{kind}")
    return f"{folder}/documents.{kind}"


@_query(_ALL)
def source_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return _as_documents(spark, _stored(spark, sf, "jsonl"))


@_query(_ALL)
def source_jsonl_gzip(spark: SparkSession, sf: str) -> DataFrame:
    return _as_documents(spark, _stored(spark, sf, "jsonl.gz"))


@_query(_ALL)
def source_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _as_documents(spark, _stored(spark, sf, "parquet"))


@_query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx, doc_id::VARCHAR AS id, text FROM documents WHERE text IS NOT NULL")
def source_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a DataFrame with their dense index."""
    return read_documents(spark, spark.read.parquet(f"{sf}/documents.parquet"), "text", "doc_id").select("doc_idx", "id", "text")


@_query("SELECT item_id, text FROM benchmark")
def source_list(spark: SparkSession, sf: str) -> DataFrame:
    records = [r.asDict() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]  # a small table, as a user's list would be
    return read_documents(spark, records, "text", "item_id").select(F.col(ID).alias("item_id"), "text")


#: One shingle holds all the words of a text, so that a run removes exact copies alone and SQL can tell its result.
_EXACT = dict(shingle_mode="word", shingle_size=1_000_000, cjk_ratio_threshold=1.0, id_field="doc_id", representative_strategy="first")
_ONCE = f"SELECT doc_id, text, lang, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY regexp_extract_all({_norm()}, '{_WORD}') ORDER BY doc_id) = 1"


def _ran(spark: SparkSession, sf: str, output_format: str, resume: bool = False) -> DataFrame:
    out = f"{shared_path(spark, 'run')}.{output_format}"
    c = PipelineConfig(output_format=output_format, checkpoint_dir=f"{out}.stages" if resume else None, **_EXACT)
    for again in (False, True)[: 1 + resume]:
        DedupPipeline(c, spark).run(f"{sf}/documents.parquet", out, resume=again)
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    return spark.read.schema(schema).format("json" if output_format == "jsonl" else "parquet").load(out)


@_query(_ONCE)
def run_to_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return _ran(spark, sf, "jsonl")


@_query(_ONCE)
def run_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return _ran(spark, sf, "parquet")


@_query(_ONCE)
def run_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A second run takes up the stored stages of the first."""
    return _ran(spark, sf, "parquet", resume=True)


@_query(f"WITH kept AS ({_ONCE}) SELECT n AS input_count, m AS output_count, (n - m) / n AS dedup_rate FROM (SELECT count(*) AS n FROM documents), (SELECT count(*) AS m FROM kept)")
def run_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The figures that a run writes beside its output."""
    out = f"{shared_path(spark, 'run')}.parquet"
    DedupPipeline(PipelineConfig(output_format="parquet", **_EXACT), spark).run(f"{sf}/documents.parquet", out)
    return spark.read.option("multiLine", True).schema("input_count long, output_count long, dedup_rate double").json(stats_path(out))


@_query("SELECT DISTINCT text FROM documents")
def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of the documents in two batches or more, without repetitions."""
    folder = shared_path(spark, "stream")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = docs.schema
    docs.repartition(2, "doc_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    deduplicate_stream(stream, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint", PipelineConfig(**_EXACT)).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out").select("text")


# --- evaluation -----------------------------------------------------------------------------------------------
@_query(f"""WITH RECURSIVE {_CLUSTERS}, {_TRUTH}, within AS (SELECT a.d AS i, b.d AS j FROM clusters a JOIN clusters b ON a.c = b.c AND a.d < b.d),
n AS (SELECT count_if(w.i IS NOT NULL AND t.i IS NOT NULL) AS tp, count_if(t.i IS NULL) AS fp, count_if(w.i IS NULL) AS fn FROM within w FULL JOIN truth t ON w.i = t.i AND w.j = t.j)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM n""")
def pair_confusion(spark: SparkSession, sf: str) -> DataFrame:
    truth = S.exact_jaccard_pairs(written(_portable_sets(_documents(spark, sf)), "sets"), THRESHOLD, "doc_idx").select("i", "j")
    return E.cluster_confusion(_portable_clusters(spark, sf), truth)


@_query(f"""WITH RECURSIVE {_CLUSTERS}, {_TRUTH}, within AS (SELECT a.d AS i, b.d AS j, least(n, 10) AS size FROM clusters a JOIN clusters b ON a.c = b.c AND a.d < b.d JOIN (SELECT c, count(*) AS n FROM clusters GROUP BY c) s ON s.c = a.c),
n AS (SELECT coalesce(size, 0) AS size, count_if(w.i IS NOT NULL AND t.i IS NOT NULL) AS tp, count_if(t.i IS NULL) AS fp, count_if(w.i IS NULL) AS fn FROM within w FULL JOIN truth t ON w.i = t.i AND w.j = t.j GROUP BY ALL)
SELECT size, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM n""")
def metrics_by_cluster_size(spark: SparkSession, sf: str) -> DataFrame:
    truth = S.exact_jaccard_pairs(written(_portable_sets(_documents(spark, sf)), "sets"), THRESHOLD, "doc_idx").select("i", "j")
    return E.metrics_by_cluster_size(_portable_clusters(spark, sf), truth)


@_query()
def near_duplicate_injection(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of the true pairs of 50 injected near duplicates; pairs of documents that were alike before count as false."""
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("id"), "text")
    more, truth = E.inject_near_duplicates(docs, min(50, docs.count()), 0.95)
    p = DedupPipeline(PipelineConfig(shingle_mode="word", shingle_size=K), spark)
    signatures = written(p.compute_signatures(p.shingle_batch(p.normalize_batch(more))), "signatures")
    return E.cluster_confusion(p.cluster_duplicates(p.duplicate_edges(signatures)), truth)


@_query("""WITH k AS (SELECT quality::VARCHAR AS a, (1 - toxic)::VARCHAR AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), m AS (SELECT count(*) AS n, count_if(a = b) / count(*) AS agreement FROM k),
c AS (SELECT sum(x * y)::DOUBLE AS s FROM (SELECT a, count(*) AS x FROM k GROUP BY a) JOIN (SELECT b, count(*) AS y FROM k GROUP BY b) ON a = b)
SELECT n, agreement, s / (n * n) AS by_chance, (agreement - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM m, c""")
def annotator_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Quality against the absence of toxicity, as if two annotators' judgements."""
    return E.cohens_kappa(_read(spark, sf, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")


_GRID = "grid AS (SELECT b, 128 // b AS r FROM (SELECT unnest(range(1, 129)) AS b) WHERE 128 % b = 0)"


@_query(f"WITH {_GRID}, p AS (SELECT b, r, round(1 - pow(1 - pow(0.8, r), b), 6) AS caught, round(pow(1 - pow(0.3, r), b), 6) AS spared FROM grid) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.caught >= p.caught AND q.spared >= p.spared AND (q.caught > p.caught OR q.spared > p.spared))")
def banding_pareto(spark: SparkSession, sf: str) -> DataFrame:
    """Bandings of 128 functions that no other beats both in pairs of similarity 0.8 caught and in pairs of 0.3 spared."""
    grid = spark.createDataFrame(factorizations(128), "b long, r long")
    at = lambda s: F.pow(1 - F.pow(F.lit(s), F.col("r")), F.col("b"))
    return E.pareto_frontier(grid.select("b", "r", F.round(1 - at(0.8), 6).alias("caught"), F.round(at(0.3), 6).alias("spared")), "caught", "spared")


@_query("SELECT round(i / 100, 6) AS similarity, round(1 - pow(1 - pow(i / 100, 8), 16), 6) AS probability FROM (SELECT unnest(range(101)) AS i)")
def s_curve(spark: SparkSession, sf: str) -> DataFrame:
    return BandingScheme(16, 8).s_curve(spark).select(F.round("similarity", 6).alias("similarity"), F.round("probability", 6).alias("probability"))


@_query(f"WITH {_GRID}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS target), p AS (SELECT t.target, b, r, 1 - pow(1 - pow(target, r), b) AS p, pow(1 / b, 1 / r) AS knee FROM grid, t) SELECT target::DOUBLE AS target, b AS bands, r AS rows, round(knee, 6) AS knee FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY p >= 0.95 DESC, CASE WHEN p >= 0.95 THEN knee ELSE p END DESC) = 1")
def recommended_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, *recommend_bands(128, t)) for t in (0.5, 0.6, 0.7, 0.8, 0.9)]
    return spark.createDataFrame(rows, "target double, bands long, rows long").withColumn("knee", F.round(F.pow(1 / F.col("bands"), 1 / F.col("rows")), 6))


@_query(f"WITH {_sets()}, {_TRUTH} SELECT i, j, round(1 - pow(1 - pow(jaccard, {ROWS}), {BANDS}), 6) AS ceiling FROM truth")
def recall_ceilings(spark: SparkSession, sf: str) -> DataFrame:
    """For every truly similar pair, the recall that banding allows."""
    return exact_jaccard_pairs(spark, sf).select("i", "j", F.round(recall_ceiling(F.col("jaccard"), BandingScheme(BANDS, ROWS)), 6).alias("ceiling"))


@_query("SELECT expected, rate, bits, greatest(1, round(bits / expected * ln(2)))::BIGINT AS hashes FROM (SELECT n AS expected, p::DOUBLE AS rate, greatest(8, ceil(ceil(-n * ln(p) / (ln(2) * ln(2))) / 8) * 8)::BIGINT AS bits FROM (SELECT unnest([1, 1000, 1000000]::BIGINT[]) AS n), (SELECT unnest([0.1, 0.01, 0.001]) AS p))")
def bloom_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, p, *bloom_sizing(n, p)) for n in (1, 1000, 1_000_000) for p in (0.1, 0.01, 0.001)], "expected long, rate double, bits long, hashes long")


@_query("""WITH v AS (SELECT vec_id AS d, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT d, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
SELECT a.d AS i, b.d AS j, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 6) AS cosine FROM u a JOIN u b ON a.d < b.d WHERE cosine >= 0.4""")
def cosine_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of cosine 0.4 or more."""
    return S.cosine_pairs(_read(spark, sf, "embeddings"), 0.4, recall=0.999999)


@_query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('0/' || doc_id), doc_id) <= 5")
def stratified_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents of every language, for annotation."""
    return E.stratified_sample(_read(spark, sf, "documents").select("doc_id", "lang"), "lang", 5, "doc_id")


@_query(f"WITH {_PAIRS}, sample AS (SELECT i, j FROM pairs ORDER BY md5('0/' || i || '/' || j), i, j LIMIT 100) SELECT i, j, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) >= {THRESHOLD} AS true_pair FROM sample JOIN sets a ON a.d = i JOIN sets b ON b.d = j")
def sampled_pair_precision(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred predicted pairs with the exact similarity that judges them."""
    sets = written(_portable_sets(_documents(spark, sf)), "sets")
    sample = E.sampled_pairs(candidate_pairs(spark, sf), 100)
    a, b = (sets.select(F.col("doc_idx").alias(k), F.col("shingles").alias(s)) for k, s in (("i", "x"), ("j", "y")))
    return sample.join(a, "i").join(b, "j").select("i", "j", (S.jaccard(F.col("x"), F.col("y")) >= THRESHOLD).alias("true_pair"))
