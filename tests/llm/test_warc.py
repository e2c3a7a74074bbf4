import random

import duckdb
import pandas as pd
import pytest

from quern.llm import warc as W

SCHEMA = "page_id long, url string, captured long, html string"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges_like_sorting(k):
    rng = random.Random(k)
    runs = [sorted(rng.choices(range(20), k=rng.randint(1, 30))) for _ in range(k)]
    rest = [iter(r[1:]) for r in runs]
    at, got = [0] * k, []
    for w in W.LoserTree([r[0] for r in runs]).merge(rest):
        got.append((runs[w][at[w]], w))
        at[w] += 1
    assert [v for v, _ in got] == sorted(v for r in runs for v in r)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:]) if a[0] == b[0])


def captures(n=400):
    rng = random.Random(4)
    urls = [f"http://{h}{p}" for h in ("www.a.com", "a.com", "b.a.com:80", "A.COM.", "z.org") for p in ("", "/", "/x?q=1", "/x?q=2#f")] + [None, "", "rel/x"]
    rows = [(i, rng.choice(urls), rng.choice([None, *range(5)]), rng.choice(["p", "q", None, ""])) for i in range(n)]
    return rows + rows[:20] + [(None, urls[0], 3, "p")] * 3 + [(7, urls[0], 1, body) for body in "pqpq"] + [(7, urls[0], 1, None)]


def brute(rows):
    """By sorting everything in one place."""
    df = pd.DataFrame(rows, columns=["page_id", "url", "t", "html"]).astype({"page_id": "Int64", "t": "Int64"})  # noqa: F841 - DuckDB reads it
    sql = W.SQL.replace(W._TIME, "t").replace("FROM pages", "FROM df")
    return [tuple(r) for r in duckdb.sql(sql + " ORDER BY position").fetchall()]


@pytest.mark.parametrize("ranges, run_rows", [(1, 10**6), (5, 30), (40, 7)])
def test_histories_equal_brute_force(spark, monkeypatch, ranges, run_rows):
    rows = captures()
    monkeypatch.setattr(W, "RUN_ROWS", run_rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = W.capture_histories(df, ranges).orderBy("position").collect()
    want = brute(rows)
    assert [r["position"] for r in got] == list(range(1, len(rows) + 1))
    for g, w in zip(got, want):
        assert (g["surt"], g["captured"], g["page_id"], g["nth"], g["n_bytes"]) == (w[1], w[2], w[3], w[4], w[6])
    # of captures of one key, time and page the lesser digest is first
    assert [r["digest"] for r in got] == [w[7] for w in want] and [r["repeats"] for r in got] == [w[5] for w in want]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(captures(10), SCHEMA).selectExpr("*", "1 AS position", "'x' AS surt", "2 AS nth")
    assert W.capture_histories(df.limit(0)).count() == 0
    assert W.capture_histories(df).columns == ["position", "surt", "captured", "page_id", "nth", "repeats", "n_bytes", "digest"]


def test_a_very_long_body_and_a_hot_url(spark):
    rows = [(1, "http://a.com/", 5, "x" * 5_000_000), (2, "http://a.com/", 6, "x" * 5_000_000)] + [(i, "http://hot.org/", i, "same") for i in range(3000)]
    got = W.capture_histories(spark.createDataFrame(rows, SCHEMA), 7).orderBy("position").collect()
    assert [r["repeats"] for r in got[:2]] == [False, True] and got[1]["n_bytes"] == 5_000_000
    assert [r["nth"] for r in got[2:]] == list(range(1, 3001)) and all(r["repeats"] for r in got[3:])


def test_keys(spark):
    for url, key in (("http://WWW2.Example.com:8080/A?b=c#d", "com,example)/A?b=c"), ("https://u@x.org", "org,x)/"), ("x", ""), (None, "")):
        got = spark.createDataFrame([(url,)], "url string").select(W.url_key(W.F.col("url")).alias("k")).first()["k"]
        assert got == key
