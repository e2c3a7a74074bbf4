"""The stages on a small table of documents, each against the operator's own verdict or brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from quern.llm import bpe, decontaminate, langid, quality, simhash
from tests.llm.test_simhash import LOST_BY_SAMPLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    lexicon = {x: ["".join(rng.choices(a, k=rng.randint(3, 8))) for _ in range(1200)] for x, a in (("en", "abcdefghij"), ("fr", "klmnopqrst"))}
    items = [(i, " ".join(rng.choices(lexicon["en"], k=30))) for i in range(5)]
    rows, labels = [], []

    def add(text, lang):
        rows.append((len(rows), text, lang, "s", len(text or "")))
        return len(rows) - 1

    for d in range(120):
        lang = "en" if d % 2 else "fr"
        if d % 4 == 0:
            i = add(" ".join(rng.choice(lexicon[lang]) + "!!" + rng.choice(["###", "$$$"]) for _ in range(60)), lang)
            labels.append((i, 0, 0))
        else:
            i = add(" ".join(rng.choices(lexicon[lang], k=rng.randint(40, 150))), lang)
            labels.append((i, 1, 0))
    good = [i for i, q, _ in labels if q]
    for i in good[:10]:
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "changed"
        add(" ".join(w), rows[i][2])
    for i in good[10:14]:
        add(rows[i][1], "en" if rows[i][2] == "fr" else "fr")
    for i, (_, text) in zip(good[20:25], items):
        add(rows[i][1] + " " + text, rows[i][2])
    add(None, "en")
    add("", "fr")
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_each_stage_acts_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench, labels = spark.read.parquet(f"{folder}/benchmark.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "language", "near_dedup", "decontaminate", "tokenize"]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "quality":
            want = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["keep"]}
        elif name == "language":
            want = {r["doc_id"] for r in langid.identify(docs).collect() if r["keep"]}
        elif name == "near_dedup":
            want = {r["class_id"] for r in simhash.near_duplicate_classes(docs).collect()}
        elif name == "decontaminate":
            want = ids(docs) - ids(decontaminate.contaminated(docs, bench))
        else:
            want = ids(docs)
            v = bpe.Encoder(bpe.Vocabulary())
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(v.decode(bpe.np.array(r["tokens"], bpe.np.int64)).tobytes().decode() == texts[r["doc_id"]] for r in after.collect())
        assert ids(after) == want and after.count() == len(want)
        if name not in ("tokenize",):
            assert after.columns == docs.columns and 0 < after.count() < docs.count()
        docs = after
    got = sorted(map(tuple, P.run(spark, folder).collect()))
    assert got == sorted(map(tuple, docs.collect()))


def test_planted_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = ids(P.run(spark, folder))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = [i for i in range(120) if i % 4]
    assert not got & {i for i in range(120) if i % 4 == 0} and None not in {text[i] for i in got} and "" not in {text[i] for i in got}
    assert len(got & set(clean)) >= 0.95 * len(clean)
    assert not got & set(range(120, 139))  # near copies, mislabelled copies, leaks


def test_every_operator_has_a_query_and_the_whole_pipeline_runs_empty(spark, folder, tmp_path):
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids_and_clashing_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS `a.b`", "'x' AS probability", "2 AS class_id", "'y' AS __row")
    some = docs.where("doc_id < 30")
    rows = some.union(some.where("doc_id in (1, 2)")).union(some.where("doc_id = 3").selectExpr("1 AS doc_id", *(f"`{c}`" for c in docs.columns[1:]))).union(some.where("doc_id = 5").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *(f"`{c}`" for c in docs.columns[1:])))
    for name, stage in P.STAGES[:-1]:
        rows = P.written(stage(spark, rows, folder), name)
        assert rows.columns == docs.columns, name
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in rows.collect())
    assert len(got) == len(set(got)) and sum(d == 1 for _, d, _ in got) == 2 and got[-1][0]
    tokens = P.STAGES[-1][1](spark, rows, folder).collect()
    assert len(tokens) == len(got) and all(r["round_trip"] for r in tokens)


def test_near_dedup_does_not_depend_on_how_many_other_documents_there_are(spark, monkeypatch):
    """Texts name their fingerprints; the pair differs in 22 bits and was lost where cells were cut, beyond 65,536 fingerprints."""

    def table(docs, *more):
        number = F.split("text", " ")
        return docs.select("doc_id", *more, *(number[k].cast("long").alias(n) for k, n in enumerate(("f1", "f2", "tokens"))))

    monkeypatch.setattr(simhash, "fingerprint_table", table)
    f = np.random.default_rng(13).integers(0, 1 << 63, (2, 70_000))
    for half in range(2):
        f[half, 1] = f[half, 0] ^ np.array(sum(1 << b % 64 for b in LOST_BY_SAMPLES if b // 64 == half), np.uint64).astype(np.int64)
    docs = spark.createDataFrame(pa.table({"doc_id": np.arange(70_000), "text": [f"{a} {b} 100" for a, b in f.T.tolist()]}))
    few, all_ = (ids(P.near_dedup(spark, d, "")) for d in (docs.where("doc_id < 10"), docs))
    assert few == {0, *range(2, 10)} and all_ == {0, *range(2, 70_000)}
