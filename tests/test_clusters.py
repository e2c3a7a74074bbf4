import itertools
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import clusters as C
from quern.operators import evaluate as E
from quern.operators import lsh
from quern.operators import similarity as S
from quern.operators.components import connected_components
from quern.operators.minhash import MinHasher


def labels(n, edges):
    """Components by walking."""
    near = {x: set() for x in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for x in range(n):
        if x not in out:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in out:
                    out[y] = x
                    todo += near[y]
    return out


@pytest.mark.parametrize("n, edges", [(6, [(0, 1), (1, 2), (4, 5)]), (60, [(i, i + 1) for i in range(59)]), (40, [(39, i) for i in range(39)]), (9, [])])
def test_components(spark, n, edges):
    rows = [*edges, *[(b, a) for a, b in edges], (3, 3), (None, 1), (1, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "i long, j long")).collect()}
    touched = {x for e in edges for x in e}
    want = labels(n, edges)
    assert got == {x: want[x] for x in touched}


@given(st.integers(1, 60), st.data())
def test_union_find_equals_walking(n, data):
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=2 * n))
    u, want = C.UnionFind.from_pairs(edges, n), labels(n, edges)
    assert u.num_elements == n and u.num_components == len(set(want.values()))
    assert all(u.connected(a, b) == (want[a] == want[b]) for a, b in itertools.combinations(range(min(n, 12)), 2))
    assert u.clusters(2) == sorted([sorted(x for x in want if want[x] == c) for c in set(want.values()) if sum(v == c for v in want.values()) > 1])


def test_union_find_grows():
    u = C.UnionFind()
    assert u.find(4) == 4 and u.num_elements == 5 and u.union(1, 9) and not u.union(9, 1)
    with pytest.raises(ValueError):
        u.find(-1)


def test_worked_example_of_buckets(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4]), (1, [1, 2, 9, 9]), (2, [7, 7, 3, 4]), (3, [5, 5, 5, 5]), (4, [7, 7, 9, 9])], "doc_idx long, signature array<long>")
    for raw in (False, True):
        keys = lsh.band_keys(df, 2, 2, raw)
        pairs = {tuple(r) for r in lsh.candidate_pairs(keys).collect()}
        assert pairs == {(0, 1), (0, 2), (1, 4), (2, 4)}
        assert sorted(r["members"] for r in lsh.buckets(keys).collect()) == [[0, 1], [0, 2], [1, 4], [2, 4]]
    with pytest.raises(Exception, match="hasn't 3 x 2 values"):
        lsh.band_keys(df, 3, 2).collect()


def test_short_cuts_connect_the_same_documents(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(3) for _ in range(8)]) for i in range(80)] + [(100 + i, [1] * 8) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_idx long, signature array<long>")
    want = sorted(map(tuple, C.duplicate_clusters(lsh.candidate_pairs(lsh.band_keys(df, 4, 2))).collect()))
    distinct, copies = lsh.collapsed(df)
    got = sorted(map(tuple, C.duplicate_clusters(copies.union(lsh.connecting_edges(lsh.band_keys(distinct, 4, 2)))).collect()))
    assert got == want and distinct.count() + copies.count() == len(rows)


def test_representatives_and_survivors(spark):
    clusters = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (5, 5), (5, 6)], "cluster_id long, doc_idx long")
    lengths = spark.createDataFrame([(0, 3), (1, 9), (2, 9), (5, 1), (6, 1), (7, 4)], "doc_idx long, length int")
    pick = lambda s: {r["cluster_id"]: r["doc_idx"] for r in C.representatives(clusters, lengths, s).collect()}
    assert pick("first") == {0: 0, 5: 5} and pick("longest") == {0: 1, 5: 5} and pick("random") == pick("random")
    kept = C.survivors(lengths, clusters, C.representatives(clusters, lengths)).collect()
    assert sorted(r["doc_idx"] for r in kept) == [1, 5, 7]
    assert {tuple(r) for r in C.size_histogram(clusters).collect()} == {(3, 1), (2, 1)}
    assert {tuple(r) for r in C.pairs_within(clusters).collect()} == {(0, 1), (0, 2), (1, 2), (5, 6)}
    with pytest.raises(ValueError):
        C.representatives(clusters, strategy="best")


def test_small_clusters_can_be_left_alone(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (7, 8)], "i long, j long")
    assert {r["cluster_id"] for r in C.duplicate_clusters(edges, 3).collect()} == {0}


def test_exact_jaccard_equals_all_pairs(spark):
    rng = random.Random(5)
    sets = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(50)]
    sets += [s[:-1] + [99] for s in sets[:20]] + [[], [], sets[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    for t in (0.3, 0.7, 1.0):
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= t}
        assert {(r["i"], r["j"]) for r in S.exact_jaccard_pairs(df, t).collect()} == want
    e = spark.createDataFrame([([], [])], "a array<int>, b array<int>")
    assert e.select(S.jaccard(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_cosine_recall_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.standard_normal((150, 16))
    v = np.concatenate([v, v[:60] + 0.2 * rng.standard_normal((60, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in itertools.combinations(range(len(v)), 2) if round(float(u[i] @ u[j]), 6) >= 0.9}
    df = spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (900, None), (901, [0.0] * 16)], "vec_id long, embedding array<double>")
    got = {(r["i"], r["j"]) for r in S.cosine_pairs(df, 0.9).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 40


def test_statistics_and_groups(spark):
    df = spark.createDataFrame([(3, "ab"), (1, "ab"), (2, ""), (4, None), (5, "xyz")], "doc_id long, text string")
    row = S.corpus_statistics(df).first()
    assert (row["documents"], row["avg_length"], row["min_length"], row["max_length"], row["exact_duplicates"]) == (4, 7 / 4, 0, 3, 1)
    assert {tuple(r) for r in S.exact_groups(df).collect()} == {(1, 2), (2, 2), (5, 1)}
    assert S.corpus_statistics(df.limit(0)).first()["documents"] == 0


def test_signature_of_empty_documents_is_one_cluster(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [5])], "doc_idx long, shingles array<long>")
    sig = MinHasher(8).signatures(df)
    assert {tuple(r) for r in lsh.candidate_pairs(lsh.band_keys(sig, 4, 2)).collect()} == {(0, 1)}


def test_components_in_one_task_equal_those_in_rounds(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    df = spark.createDataFrame(edges, "i long, j long")
    once, rounds = (sorted(map(tuple, connected_components(df, one_task=n).collect())) for n in (10**6, 0))
    assert once == rounds and once
    assert connected_components(df.limit(0)).count() == 0


def test_counts_without_pair_lists_equal_those_of_the_lists(spark):
    rng = random.Random(12)
    clusters = spark.createDataFrame([(c, 100 * c + k) for c in range(12) for k in range(2 + c)], "cluster_id long, doc_idx long")
    truth = spark.createDataFrame([(100 * rng.randrange(12) + rng.randrange(5), 100 * rng.randrange(12) + rng.randrange(5)) for _ in range(300)] + [(7, 7), (1, 0)], "i long, j long")
    assert E.cluster_confusion(clusters, truth).first() == E.confusion(C.pairs_within(clusters), truth).first()
    assert E.cluster_confusion(clusters.limit(0), truth).first() == E.confusion(C.pairs_within(clusters.limit(0)), truth).first()
    by_size = E.metrics_by_cluster_size(clusters, truth).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
    assert tuple(by_size) == tuple(E.cluster_confusion(clusters, truth).first())[:3]


def test_giant_clusters(spark):
    clusters = spark.createDataFrame([(0, 0), (0, 1), (5, 5), (5, 6), (5, 7)], "cluster_id long, doc_idx long")
    assert [tuple(r) for r in C.giant_clusters(clusters, 2).collect()] == [(5, 3)]
    assert sorted(r["doc_idx"] for r in C.without_giants(clusters, 2).collect()) == [0, 1]


def test_bucket_index_and_pair_keys(spark):
    from quern.operators import lsh

    index = lsh.BucketIndex()
    index.add(1, 4)
    index.add(1, 5)
    index.add_bucket(2, [9])
    assert len(index) == 2 and list(index.candidate_buckets()) == [[4, 5]] and index.as_dict() == {1: [4, 5], 2: [9]}
    keys = spark.createDataFrame([(0, 0, 7), (1, 0, 7), (2, 0, 8)], "doc_idx long, band int, key long")
    assert lsh.BucketIndex.from_keys(keys).as_dict() == {(0, 7): [0, 1]}
    assert lsh.encode_pair(1, 5) == 4294967301 == spark.range(1).select(lsh.encode_pair(F.lit(1), F.lit(5)).alias("k")).first()["k"]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from quern.errors import StorageError
    from quern.storage import shared_folder

    nothing = SimpleNamespace(get=lambda name: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(StorageError):
            shared_folder(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master=master)))


def test_exact_jaccard_of_near_copies_in_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.sample(range(10_000), 60) for _ in range(3)]
    sets = [sorted({x for x in b if rng.random() > 0.12} | {rng.randrange(10_000)}) for b in base for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    want = {(i, j): len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) for i, j in itertools.combinations(range(len(sets)), 2)}
    want = {k: v for k, v in want.items() if v >= 0.7}
    for size in (200_000, 300):  # one block of each family, and many
        monkeypatch.setattr(S, "BLOCK", size)
        got = [(r["i"], r["j"], r["jaccard"]) for r in S.exact_jaccard_pairs(df, 0.7).collect()]
        assert len(got) == len(want) > 200 and {(i, j): v for i, j, v in got} == want


def test_cosine_pairs_are_all_found_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [1.0, 0.0]), (901, [2.0, 0.0]), (902, [0.0] * 8), (903, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.round(u @ u.T, 6) >= 0.4
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]} | {(900, 901)}
    for size in (1 << 19, 500):  # one block, and many
        monkeypatch.setattr(S, "_VECTORS", size)
        got = [(r["i"], r["j"]) for r in S.cosine_pairs(df, 0.4).collect()]
        assert len(got) == len(set(got)) and set(got) == want
