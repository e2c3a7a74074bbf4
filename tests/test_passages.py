import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.operators import passages as P
from quern.operators import simhash64 as H


def words(column="text"):
    return F.when(F.col(column) != "", F.split(column, " ")).when(F.col(column) == "", F.array().cast("array<string>"))


def brute(rows, size):
    seen = Counter()
    for _, text in rows:
        w = (text or "").split()
        seen.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for key, text in rows:
        w, last = (text or "").split(), None
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                if last is None or i - last[0] > size - 1:
                    out.append(last := [i, key, i])
                last[0] = i
    return sorted((key, start, end - start + size) for end, key, start in out)


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(800)], k=n))
    hot, inner = text(20), text(14)
    rows = [(i, f"{text(rng.randint(0, 60))} {hot} {text(5)}") for i in range(40)]
    rows += [(100, f"{inner} {text(9)} {inner}"), (101, text(300)), (102, ""), (103, None), (104, hot), (105, "a " * 50_000), (106, " ".join(hot.split()[:11])), (107, " ".join(hot.split()[:12]))]
    rows = [(k, t and t.strip()) for k, t in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    for size in (12, 1):
        got = sorted(tuple(r) for r in P.repeated_passages(df, words(), size).collect())
        assert got == brute(rows, size) and got
    assert P.repeated_passages(df.limit(0), words(), 12).count() == 0


def test_shared_ngrams(spark):
    from quern.functions.text import ngrams

    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c y"), (3, ""), (4, None), (5, "q r")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d"), (8, "q r"), (9, ""), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["part"]) for r in P.shared_ngrams(docs, ngrams(words(), 3), items, ngrams(words(), 3)).collect()}
    assert got == {(1, 7): (2, 1.0), (2, 7): (1, 0.5), (5, 8): (1, 1.0)}


def test_simhash64_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = base + [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in base[:30] for k in (1, 3, 4)] + base[:5]
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(prints)] + [(999, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    first = {f: i for i, f in reversed(list(enumerate(prints)))}
    for most in (0, 3, 5):
        want = {(min(a, b), max(a, b), (f ^ g).bit_count()) for f, a in first.items() for g, b in first.items() if a < b and (f ^ g).bit_count() <= most}
        assert {tuple(r) for r in H.hamming_pairs(df, most).collect()} == want
    tokens = spark.createDataFrame([(1, ["the", "fox", "the"]), (2, []), (3, None)], "i int, t array<string>")
    got = {r["i"]: r["f"] for r in tokens.select("i", H.simhash64(F.col("t")).alias("f")).collect()}
    import hashlib

    sums = sum((2 * np.array([int(hashlib.md5(w.encode()).hexdigest(), 16) >> b & 1 for b in range(64)]) - 1 for w in ("the", "fox", "the")), np.zeros(64))
    want = sum(1 << b for b in range(64) if sums[b] > 0)
    assert got == {1: want - (1 << 64) if want >> 63 else want, 2: 0, 3: 0}
