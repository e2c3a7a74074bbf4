import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import quality as Q

SCHEMA = "doc_id long, text string"
GOOD, BAD = "the of and to in is it as with for on by".split(), "### $$$ buy!! click!! %%% &&& win!! free!!".split()


def document(rng, good):
    lexicon = GOOD if good else BAD + GOOD[:4]
    return " ".join(rng.choice(lexicon) + ("" if rng.random() < 0.6 else "".join(rng.choices("abcdefg", k=3))) for _ in range(rng.randint(20, 120)))


def corpus(seed, n=160):
    rng = random.Random(seed)
    return [(i, document(rng, i % 3 > 0)) for i in range(n)], [(i, int(i % 3 > 0)) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus(1)
    return Q.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))


def test_word_vectors_equal_brute_force(spark):
    texts = ["a b c a", "c!! b", "", None, "a b c a"]
    got = Q.word_vectors(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    places, signs = Q.index_vectors()
    want = np.zeros((Q.VOCABULARY, Q.DIM))
    for e in range(2):
        want[np.arange(Q.VOCABULARY), places[:, e]] += signs[:, e]
    for t in texts:
        cp = np.frombuffer((t or "").encode("utf-32-le"), np.uint32)
        tok = Q.token_buckets(cp, np.array([0, len(cp)]))[0].tolist()
        for i, w in enumerate(tok):
            for j in range(max(0, i - Q.WINDOW), min(len(tok), i + Q.WINDOW + 1)):
                if i != j:
                    for e in range(2):
                        want[w, places[tok[j], e]] += signs[tok[j], e]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(got - want).max() < 1e-6


def test_held_out_accuracy_and_calibration(model):
    docs, labels = corpus(99)
    p, keep = Q._probabilities(model, pa.array([t for _, t in docs]))
    y = np.array([q for _, q in labels])
    assert (keep == (y > 0)).mean() >= 0.95
    assert abs(p.mean() - y.mean()) < 0.1


def test_pooling_equals_definition(model):
    vectors = model[0]
    cp = np.frombuffer("one two ### one".encode("utf-32-le"), np.uint32)
    x, n = Q.pooled(cp, np.array([0, len(cp)]), vectors)
    v = vectors[Q.token_buckets(cp, np.array([0, len(cp)]))[0]].astype(float)
    assert n[0] == 4 and np.allclose(x[0], np.concatenate([v.mean(axis=0), v.std(axis=0)]), atol=1e-6)


def test_edge_cases(spark):
    docs, labels = corpus(3, 60)
    rows = [(i, t, "a", 0.5) for i, t in docs] + [(500, None, "a", None), (501, "", None, None), (502, " \n ", "b", 1.0), (None, docs[1][1], "c", 1.0), (1, docs[1][1], "d", 1.0), (503, "the of and " * 40_000, "e", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string, probability double")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (9999, 1), (0, 0), (0, 1)], "doc_id long, quality int").selectExpr("*", "'x' as text")
    got = Q.classify(df, marks).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert not any(by[i]["keep"] for i in (500, 501, 502)) and by[500]["probability"] == 0
    assert by[503]["keep"] and by[None]["probability"] == by[1]["probability"]
    kept = Q.of_quality(df, marks)
    assert kept.columns == df.columns and kept.count() == sum(r["keep"] for r in got)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.classify(spark.createDataFrame([(1, "abc"), (2, "")], SCHEMA), none).collect()
    assert [(r["doc_id"], r["probability"], r["keep"]) for r in sorted(got)] == [(1, None, True), (2, None, False)]
    assert Q.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_fitting_is_bounded_and_repeatable(spark):
    docs, labels = corpus(5, 60)
    a, b = (Q.train(spark.createDataFrame(docs, SCHEMA).repartition(n), spark.createDataFrame(labels, "doc_id long, quality int"), rows=30)[1] for n in (1, 3))
    assert len(a.held) == 6 and all(np.array_equal(x, y) for x, y in zip(a.w, b.w))


def test_labels_of_other_documents_don_t_use_up_the_bound(spark):
    docs, labels = corpus(7, 40)
    more = labels + [(10_000 + i, i % 2) for i in range(4000)]
    a, b = (Q.train(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(x, "doc_id long, quality int"), rows=30)[1] for x in (labels, more))
    assert a is not None and b is not None and all(np.array_equal(x, y) for x, y in zip(a.w, b.w))
