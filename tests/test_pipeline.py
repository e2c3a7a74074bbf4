import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

import quern
from quern import cli
from quern.config import PipelineConfig
from quern.errors import CheckpointError, ConfigError, DedupError, EvaluationError, StorageError
from quern.operators import clusters as C
from quern.operators import evaluate as E
from quern.plans.checkpoint import StageStore, fingerprint
from quern.plans.pipeline import DedupPipeline
from quern.plans.tuning import evaluate, tune
from quern.sources.readers import read_documents
from quern.sources.tables import with_index
from quern.sources.writers import alarm, dedup_rate, stats_path

WORDS = dict(shingle_mode="word", shingle_size=3, jaccard_threshold=0.7)


def records(n, seed, words=60, vocabulary=4000):
    rng = random.Random(seed)
    return [{"id": f"u{i}", "text": " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))} for i in range(n)]


def rows_of(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8") as f:
                out += [json.loads(line) for line in f]
    return out


# --- configuration and errors
def test_config(tmp_path):
    assert PipelineConfig().to_dict()["num_hash_functions"] == 128
    for bad in ({"shingle_size": 0}, {"shingle_mode": "x"}, {"lsh_bands": 15}, {"jaccard_threshold": 1.5}, {"random_seed": -1}, {"min_cluster_size": 1}, {"bloom_false_positive_rate": 1.0}, {"shingle_size": "5"}, {"use_numba": 1}, {"unknown": 1}):
        with pytest.raises(ConfigError):
            PipelineConfig.from_mapping(bad)
    env = {"DEDUP_SHINGLE_SIZE": "3", "DEDUP_HIGH_PRECISION_MODE": "true", "DEDUP_JACCARD_THRESHOLD": "0.5", "OTHER": "x"}
    c = PipelineConfig.from_env(env, shingle_mode="word")
    assert (c.shingle_size, c.high_precision_mode, c.jaccard_threshold, c.shingle_mode) == (3, True, 0.5, "word")
    with pytest.raises(ConfigError):
        PipelineConfig.from_env({"DEDUP_SHINGLE_SIZE": "x"})
    (tmp_path / "c.json").write_text('{"shingle_size": 4}')
    assert PipelineConfig.from_json(str(tmp_path / "c.json"), shingle_mode="word").shingle_size == 4
    (tmp_path / "d.json").write_text("[1]")
    for name in ("d.json", "none.json"):
        with pytest.raises(ConfigError):
            PipelineConfig.from_json(str(tmp_path / name))
    with pytest.raises(Exception):  # noqa: B017 - frozen
        c.shingle_size = 9


def test_errors_have_one_root():
    assert all(issubclass(getattr(quern, n), DedupError) for n in ("ConfigError", "HashingError", "IOError", "CheckpointError", "EvaluationError"))


# --- sources and sinks
def test_json_lines_skip_what_isn_t_a_document(spark, tmp_path):
    lines = ['{"id": "a", "text": "one", "lang": "en", "n": 1}', "", "not json", "[1]", '{"id": "b"}', '{"id": "c", "text": 5}', '{"text": "two", "n": 2}', '{"id": null, "text": ""}']
    plain, packed = tmp_path / "x.jsonl", tmp_path / "x.jsonl.gz"
    plain.write_text("\n".join(lines))
    with gzip.open(packed, "wt") as f:
        f.write("\n".join(lines))
    for path in (plain, packed):
        df = read_documents(spark, str(path))
        assert df.columns[:3] == ["doc_idx", "id", "text"] and set(df.columns[3:]) == {"lang", "n", "__record", "__id"}
        assert [(r["doc_idx"], r["id"], r["text"], r["n"]) for r in df.orderBy("doc_idx").collect()] == [(0, "a", "one", 1), (1, "1", "two", 2), (2, "2", "", None)]


def test_other_sources(spark, tmp_path):
    df = spark.createDataFrame([("k1", "b", 1), ("k0", "a", 2)], "key string, body string, text int")
    df.write.parquet(str(tmp_path / "p.parquet"))
    got = read_documents(spark, str(tmp_path / "p.parquet"), "body", "key")
    assert got.columns == ["doc_idx", "id", "text", "__id"] and got.count() == 2
    assert [r["id"] for r in read_documents(spark, df, "body", "key").orderBy("doc_idx").collect()] == ["k0", "k1"]
    for i in (2, 10, 1):
        (tmp_path / f"g{i}.jsonl").write_text(json.dumps({"id": i, "text": f"t{i}"}))
    assert [r["text"] for r in read_documents(spark, str(tmp_path / "g*.jsonl")).orderBy("doc_idx").collect()] == ["t1", "t10", "t2"]
    assert [r["id"] for r in read_documents(spark, [{"text": "x"}, {"text": 3}, {"text": "y", "id": 7}, 5]).orderBy("doc_idx").collect()] == ["0", "7"]
    assert read_documents(spark, []).count() == 0
    for bad in (str(tmp_path / "none*.jsonl"), "some/hub-data-set", str(tmp_path / "p.parquet" / "_SUCCESS"), 5):
        with pytest.raises(StorageError):
            read_documents(spark, bad)
    with pytest.raises(StorageError):
        read_documents(spark, df, "nothing")


def test_index_is_dense_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert [r["doc_idx"] for r in with_index(df, "k").where("doc_idx <> k").collect()] == []
    assert with_index(df.limit(0), "k").count() == 0


def test_figures():
    assert dedup_rate(0, 0) == 0 and dedup_rate(10, 4) == 0.6
    assert alarm(0.01) and alarm(0.9) and alarm(0.3) is None and stats_path("/a/b.jsonl") == "/a/b_stats.json"


# --- whole runs
def test_exact_copies_go_and_survivors_are_verbatim(spark, tmp_path):
    base = records(150, 1)
    base[0]["text"] = "  <b>Kept</b>  As  Is &amp; " + base[0]["text"]
    rng = random.Random(2)
    copies = [dict(base[rng.randrange(150)], id=f"d{k}") for k in range(20)]
    stats = DedupPipeline(PipelineConfig(**WORDS), spark).run(base + copies, str(tmp_path / "out.jsonl"))
    rows = rows_of(tmp_path / "out.jsonl")
    assert stats["input_count"] == 170 and stats["output_count"] == len(rows) == 150
    assert sorted((r["id"], r["text"]) for r in rows) == sorted((r["id"], r["text"]) for r in base)
    assert [r["id"] for r in rows] == [r["id"] for r in base]
    written = json.loads((tmp_path / "out_stats.json").read_text())
    assert written["cluster_size_histogram"] == stats["cluster_size_histogram"] and all(isinstance(k, str) for k in written["cluster_size_histogram"])


def test_every_record_is_written_as_it_came(spark, tmp_path):
    data = [
        {"id": 1, "text": "first of all documents here", "meta": {"a": [1, 2], "b": None}},
        {"id": "b", "text": "second, quite another text", "n": 1},
        {"text": "third: no id at all", "x.y": "dotted", "n": 2.5, "flag": True, "empty": None},
        {"id": None, "text": "fourth: über 日本", "n": "one"},
    ]
    lines = [json.dumps(r, ensure_ascii=False) for r in data]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    for source in (data, str(tmp_path / "in.jsonl")):
        for single in (False, True):
            out = tmp_path / f"out{single}.jsonl"
            stats = DedupPipeline(PipelineConfig(single_file=single, **WORDS), spark).run(source, str(out))
            assert stats["output_count"] == 4 and stats["cjk_documents"] == 0 and stats["total_shingles"] > 4
            assert (out.read_text().splitlines() if single else [json.dumps(r, ensure_ascii=False) for r in rows_of(out)]) == lines
    rows = [(7, "first of all documents here", None, [1, 2]), (None, "second, quite another text", 2.5, None)]
    df = spark.createDataFrame(rows, "id int, text string, `n.x` double, tags array<int>")
    df.write.parquet(str(tmp_path / "in.parquet"))
    for source in (df, str(tmp_path / "in.parquet")):
        for kind in ("parquet", "jsonl"):
            out = str(tmp_path / f"o.{kind}")
            DedupPipeline(PipelineConfig(output_format=kind, **WORDS), spark).run(source, out)
            if kind == "parquet":
                got = spark.read.parquet(out)
                assert got.schema == df.schema and sorted(map(tuple, got.collect()), key=lambda r: r[1]) == rows
            else:
                assert sorted(rows_of(out), key=lambda r: r["text"]) == [dict(zip(df.columns, r)) for r in rows]
    docs = [quern.Document.from_row(r) for r in read_documents(spark, data).orderBy("doc_idx").collect()]
    assert [(d.id, d.metadata) for d in docs] == [("1", data[0]), ("b", data[1]), ("2", data[2]), ("3", data[3])]


@pytest.mark.parametrize("texts, left", [([f"text number {i} " + "abc " * i for i in range(5)], None), (["same text here"] * 30, 1), (["", " ", "!"], 1), ([], 0)])
def test_extremes(spark, tmp_path, texts, left):
    c = PipelineConfig(shingle_mode="word", shingle_size=2, output_format="parquet")
    stats = DedupPipeline(c, spark).run([{"id": str(i), "text": t} for i, t in enumerate(texts)], str(tmp_path / "o.parquet"))
    out = spark.read.parquet(str(tmp_path / "o.parquet"))
    assert out.count() == stats["output_count"] and (left is None or stats["output_count"] == left) and "text" in out.columns


def test_near_copies_f1(spark):
    docs = spark.createDataFrame([(i, r["id"], r["text"]) for i, r in enumerate(records(300, 10, 80))], "doc_idx long, id string, text string")
    more, truth = E.inject_near_duplicates(docs, 30, 0.96, seed=11)
    source = more.select("id", "text", F.col("doc_idx").alias("n"))
    p = DedupPipeline(PipelineConfig(**WORDS), spark)
    n = p.normalize_batch(source.select(F.col("n").alias("doc_idx"), "text"))
    found = C.pairs_within(p.cluster_duplicates(p.duplicate_edges(p.compute_signatures(p.shingle_batch(n)))))
    assert E.confusion(found, truth).first()["f1"] >= 0.85


def test_high_precision_verifies_edges(spark):
    loose = dict(WORDS, num_hash_functions=16, lsh_bands=16, lsh_rows=1, jaccard_threshold=0.9)
    docs = [{"id": str(i), "text": " ".join(f"w{j}" for j in range(4 * i, 4 * i + 40))} for i in range(6)]
    n = {}
    for precise in (False, True):
        clusters, total = DedupPipeline(PipelineConfig(high_precision_mode=precise, **loose), spark).detect_clusters(docs)
        n[precise] = clusters.count()
        assert total == 6
    assert n[True] < n[False] == 6


def test_resume_takes_up_stored_stages(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    data = records(60, 5, 40, 500)
    source.write_text("\n".join(json.dumps(r) for r in data + [dict(r, id="d" + r["id"]) for r in data[:8]]))
    c = PipelineConfig(num_hash_functions=64, lsh_bands=16, lsh_rows=4, checkpoint_dir=str(tmp_path / "c"), **WORDS)
    p = DedupPipeline(c, spark)
    first = p.run(str(source), str(tmp_path / "a.jsonl"))
    stored = StageStore(spark, c.checkpoint_dir).list()
    assert stored == ["candidate_pairs", "clusters", "documents", "dropped", "signatures"]
    when = {n: os.path.getmtime(tmp_path / "c" / n) for n in stored}
    again = p.run(str(source), str(tmp_path / "b.jsonl"), resume=True)
    assert rows_of(tmp_path / "a.jsonl") == rows_of(tmp_path / "b.jsonl") and first["output_count"] == again["output_count"] == 60
    assert {n: os.path.getmtime(tmp_path / "c" / n) for n in stored} == when
    with pytest.raises(CheckpointError):
        DedupPipeline(c.replace(shingle_size=4), spark).run(str(source), str(tmp_path / "d.jsonl"), resume=True)


def test_resume_refuses_another_content(spark, tmp_path):
    a, b = ([{"id": str(i), "text": f"{x} text number {i} of a list"} for i in range(5)] for x in "ab")
    c = PipelineConfig(checkpoint_dir=str(tmp_path / "c"), **WORDS)
    frame = lambda rows: spark.createDataFrame([(r["id"], r["text"]) for r in rows], "id string, text string")
    path = tmp_path / "in.jsonl"
    for kind in (list, frame, lambda rows: (path.write_text("\n".join(map(json.dumps, rows)) + "\n" * (rows is b)), str(path))[1]):
        DedupPipeline(c, spark).run(kind(a), str(tmp_path / "o.jsonl"))
        again = DedupPipeline(c, spark).run(kind(a) if kind in (list, frame) else str(path), str(tmp_path / "o.jsonl"), resume=True)
        assert again["input_count"] == 5
        with pytest.raises(CheckpointError):
            DedupPipeline(c, spark).run(kind(b), str(tmp_path / "o.jsonl"), resume=True)


def test_store(spark, tmp_path):
    s = StageStore(spark, str(tmp_path / "s"), fingerprint("a", 1))
    assert s.list() == [] and not s.has("x") and not s.delete("x")
    s.save("x", spark.range(3))
    assert s.has("x") and s.list() == ["x"] and s.load("x").count() == 3
    with pytest.raises(CheckpointError):
        StageStore(spark, str(tmp_path / "s"), "other").load("x")
    assert s.delete("x") and not s.has("x")
    with pytest.raises(CheckpointError):
        s.load("x")
    off = StageStore(spark, None)
    assert not off.enabled and off.save("x", spark.range(2)).count() == 2 and off.list() == []


# --- evaluation
def test_confusion(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "i long, j long")
    row = E.confusion(pairs([(1, 0), (2, 3), (4, 4)]), pairs([(0, 1), (5, 6), (6, 5)])).first()
    assert tuple(row) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(E.confusion(pairs([]), pairs([])).first()) == (0, 0, 0, 1.0, 1.0, 1.0)
    assert tuple(E.confusion(pairs([(0, 1)]), pairs([(2, 3)])).first())[3:] == (0.0, 0.0, 0.0)
    with pytest.raises(EvaluationError):
        E.canonical_pairs(spark.range(2))


def test_sampled_precision(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)], "i long, j long")
    assert E.estimate_precision(pairs, F.col("i") < 10, 40) == 0.25 == E.estimate_precision(pairs, lambda p: p[0] < 10, 100)
    assert E.sampled_pairs(pairs, 7).count() == 7 and E.sampled_pairs(pairs, 7).collect() == E.sampled_pairs(pairs.repartition(5), 7).collect()
    for bad in (lambda: E.estimate_precision(pairs, F.lit(True), 0), lambda: E.estimate_precision(pairs.limit(0), F.lit(True), 3)):
        with pytest.raises(EvaluationError):
            bad()


def test_injection(spark):
    docs = spark.createDataFrame([(i, str(i), " ".join(f"t{i}_{k}" for k in range(50))) for i in range(20)], "doc_idx long, id string, text string")
    more, truth = E.inject_exact_duplicates(docs, 5, seed=3)
    rows = {r["doc_idx"]: r for r in more.collect()}
    assert len(rows) == 25 and all(rows[j]["text"] == rows[i]["text"] and rows[j]["id"] == f"dup{j - 20}" for i, j in truth.collect())
    for mode in ("delete", "substitute"):
        more, truth = E.inject_near_duplicates(docs, 6, 0.8, mode)
        rows = {r["doc_idx"]: set(r["text"].split()) for r in more.collect()}
        assert all(abs(len(rows[i] & rows[j]) / len(rows[i] | rows[j]) - 0.8) < 0.03 for i, j in truth.collect())
        assert more.orderBy("doc_idx").collect() == E.inject_near_duplicates(docs, 6, 0.8, mode)[0].orderBy("doc_idx").collect()
    assert E.edit_fraction_for_jaccard(0.5, "delete") == 0.5 and E.make_near_duplicate("", 0.5, random.Random(0)) == ""
    for bad in (lambda: E.inject_exact_duplicates(docs, 21), lambda: E.edit_fraction_for_jaccard(0, "delete"), lambda: E.edit_fraction_for_jaccard(0.5, "x"), lambda: E.make_near_duplicate("a", 1.0, random.Random(0))):
        with pytest.raises(EvaluationError):
            bad()


def test_kappa_pareto_strata_and_sizes(spark):
    labels = spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15 + [(None, 1)], "a int, b int")
    row = E.cohens_kappa(labels, "a", "b").first()
    assert (row["n"], row["agreement"], row["by_chance"]) == (50, 0.7, 0.5) and abs(row["kappa"] - 0.4) < 1e-12
    points = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.5, 0.5), ("c", 0.5, 0.4), ("d", 0.4, 0.5), ("e", 0.1, 0.9), ("f", 0.9, 0.1)], "n string, precision double, recall double")
    assert {r["n"] for r in E.pareto_frontier(points).collect()} == {"a", "b", "e", "f"}
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_idx long, s int")
    assert [r["count"] for r in E.stratified_sample(rows, "s", 4).groupBy("s").count().collect()] == [4, 4, 4]
    clusters = spark.createDataFrame([(0, 0), (0, 1), (5, 5), (5, 6), (5, 7)], "cluster_id long, doc_idx long")
    truth = spark.createDataFrame([(0, 1), (5, 6), (8, 9)], "i long, j long")
    assert {(r["size"], r["tp"], r["fp"], r["fn"]) for r in E.metrics_by_cluster_size(clusters, truth).collect()} == {(2, 1, 0, 0), (3, 1, 2, 0), (0, 0, 0, 1)}


def test_evaluate_tune_and_command_line(spark, tmp_path, capsys):
    data = records(30, 8, 30)
    data += [dict(r, id="c" + r["id"]) for r in data[:4]]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(r) for r in data))
    (tmp_path / "t.json").write_text(json.dumps({"pairs": [[30 + k, k] for k in range(4)]}))
    c = PipelineConfig(num_hash_functions=4, lsh_bands=2, lsh_rows=2, **WORDS)
    truth = cli.read_truth(spark, str(tmp_path / "t.json"))
    assert evaluate(DedupPipeline(c, spark), str(tmp_path / "d.jsonl"), truth)["f1"] == 1.0
    results = tune(str(tmp_path / "d.jsonl"), truth, c, spark, sizes=(3,), thresholds=(0.7, 0.9))
    assert len(results) == 6 and [r["f1"] for r in results] == sorted((r["f1"] for r in results), reverse=True)
    sets = ["--set", "shingle_mode=word", "--set", "shingle_size=3"]
    assert cli.main(["deduplicate", str(tmp_path / "d.jsonl"), str(tmp_path / "o.jsonl"), *sets], spark) == 0
    assert json.loads(capsys.readouterr().out)["output_count"] == 30
    assert cli.main(["inspect", str(tmp_path / "d.jsonl")], spark) == 0
    assert json.loads(capsys.readouterr().out)["exact_duplicates"] == 4
    assert cli.main(["benchmark", str(tmp_path / "d.jsonl"), "--n-docs", "10", *sets], spark) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 10
    assert cli.main(["inspect", str(tmp_path / "nothing.jsonl")], spark) == 1
    (tmp_path / "bad.json").write_text('{"pairs": [[1]]}')
    with pytest.raises(EvaluationError):
        cli.read_truth(spark, str(tmp_path / "bad.json"))


def test_stream_is_deduplicated_across_batches(spark, tmp_path):
    from quern.streaming.incremental import deduplicate_stream

    data = records(40, 9)
    schema = "id string, text string"
    c = PipelineConfig(**WORDS)
    for turn, part in enumerate([data[:20] + data[:3], data[10:40]]):
        spark.createDataFrame([(r["id"], r["text"]) for r in part], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        deduplicate_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), c).awaitTermination(120)
        got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert len(got) == len(set(got)) == (20 if turn == 0 else 40)
