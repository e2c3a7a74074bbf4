import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.errors import ConfigError, HashingError
from quern.functions import hashing as H
from quern.operators.minhash import MinHasher, SignatureStore


def brute(s, family):
    a, b = family
    return [min(((int(x) % (1 << 64)) % H.PRIME * int(p) + int(q)) % H.PRIME for x in s) if s else H.EMPTY for p, q in zip(a, b)]


def test_coefficients_are_those_of_the_seed():
    a, b = H.coefficients(128)
    assert a[:3].tolist() == [383329928, 3324115913, 2811363262] and b[:3].tolist() == [2467890884, 2726094422, 2428259940]
    with pytest.raises(HashingError):
        H.coefficients(0)
    with pytest.raises(HashingError):
        H.hash_value(1, 128, (a, b))


def test_signatures_in_all_forms(spark):
    rng = np.random.default_rng(1)
    sets = [rng.integers(-(1 << 63), 1 << 63, n).tolist() for n in (0, 1, 2, 50, 3000)] + [[], [-1, 0, (1 << 63) - 1, -(1 << 63)]]
    h = MinHasher(16)
    want = [brute(s, h.family) for s in sets]
    assert h.batch_transform(sets).tolist() == want and h.transform(sets[3]).tolist() == want[3]
    df = spark.createDataFrame([*enumerate(sets), (99, None)], "doc_idx long, shingles array<long>")
    for got in (h.signatures(df), h.signatures_by_aggregation(df)):
        by = {r["doc_idx"]: r["signature"] for r in got.collect()}
        assert [by[i] for i in range(len(sets))] == want and by[99] == [H.EMPTY] * 16


def test_blocks_don_t_change_signatures():
    rng = np.random.default_rng(2)
    values = rng.integers(-(1 << 63), 1 << 63, 400_000)
    bounds = np.array([0, 10, 10, 200_000, 200_001, 400_000])
    family = H.coefficients(4)
    got = H.minhash(values, bounds, family)
    for r in range(5):
        assert got[r].tolist() == H.minhash(values[bounds[r] : bounds[r + 1]], np.array([0, bounds[r + 1] - bounds[r]]), family)[0].tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(10, 300), st.floats(0, 1))
def test_estimate_is_within_two_standard_errors_on_average(n, share):
    common = int(n * share)
    a, b = set(range(n)), set(range(n - common, 2 * n - common))
    j = len(a & b) / len(a | b)
    errors = [abs(h.estimate_jaccard(h.transform(a), h.transform(b)) - j) for h in (MinHasher(128, s) for s in range(4))]
    assert np.mean(errors) <= 2 / np.sqrt(128)


def test_estimate_column(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 9, 9])], "a array<long>, b array<long>")
    assert df.select(H.estimate_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.5
    with pytest.raises(Exception, match="different length"):
        spark.createDataFrame([([1], [1, 2])], "a array<long>, b array<long>").select(H.estimate_jaccard(F.col("a"), F.col("b"))).collect()
    with pytest.raises(HashingError):
        MinHasher(4).estimate_jaccard(np.zeros(3), np.zeros(4))


def test_universal_hash_column_equals_scalar(spark):
    family = H.coefficients(5)
    xs = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 123456789]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for i in range(5):
        got = [r[0] for r in df.select(H.universal_hash(H.reduced(F.col("x")), int(family[0][i]), int(family[1][i]))).collect()]
        assert got == [H.hash_value(x, i, family) for x in xs]


def test_banding_arithmetic(spark):
    s = H.BandingScheme(16, 8)
    assert abs(s.threshold - 0.7071) < 1e-4 and abs(s.probability_at(0.8) - 0.947) < 1e-3 and abs(s.probability_at(0.5) - 0.0607) < 1e-3
    assert s.slices()[1] == slice(8, 16)
    curve = [r["probability"] for r in s.s_curve(spark, 11).orderBy("similarity").collect()]
    assert curve == sorted(curve) and curve[0] == 0 and curve[-1] == 1
    b, r = H.recommend_bands(128, 0.8)
    assert b * r == 128 and H.candidate_probability(0.8, b, r) >= 0.95
    assert H.recommend_bands(7, 0.01) == (7, 1)
    for bad in (lambda: H.BandingScheme(0, 1), lambda: H.BandingScheme(2, 3, 7), lambda: H.recommend_bands(0, 0.5)):
        with pytest.raises(ConfigError):
            bad()


def test_bloom_filter():
    assert H.bloom_sizing(1000, 0.01) == (9592, 7) and H.bloom_sizing(1, 0.9)[0] == 8
    f = H.BloomFilter(500, 0.01)
    pairs = [(i, i + 1) for i in range(500)]
    assert sum(f.add_if_absent(*p) for p in pairs) >= 490
    assert all(p in f for p in pairs) and sum((i, i + 7) in f for i in range(10_000, 12_000)) < 80
    with pytest.raises(ConfigError):
        H.bloom_sizing(0, 0.1)


def test_store(spark, tmp_path):
    s = SignatureStore(spark, str(tmp_path / "s"), 2)
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "doc_idx long, signature array<long>")
    s.write(df)
    s.append(spark.createDataFrame([(2, [5, 6])], df.schema))
    assert len(s) == 3 and s.get(2) == [5, 6]
    assert {r["doc_idx"] for r in s.get_many(spark.createDataFrame([(0,), (2,), (9,)], "doc_idx long")).collect()} == {0, 2}
    with pytest.raises(HashingError):
        s.get(7)
    with pytest.raises(Exception, match="hasn't 2 values"):
        s.append(spark.createDataFrame([(3, [1])], df.schema))


def test_sets_of_one_shingle_that_are_equal_modulo_the_prime_stay_apart(spark):
    from quern.config import PipelineConfig
    from quern.operators.clusters import duplicate_clusters
    from quern.plans.pipeline import DedupPipeline

    sets = [(0, [7]), (1, [7 + H.PRIME]), (2, [7]), (3, [-9]), (4, [-9 - H.PRIME]), (5, []), (6, None)]
    df = spark.createDataFrame(sets, "doc_idx long, shingles array<long>")
    p = DedupPipeline(PipelineConfig(), spark)
    signatures = p.compute_signatures(df)
    by = {r["doc_idx"]: r for r in signatures.collect()}
    assert by[0]["signature"] == by[1]["signature"] and by[0]["origins"] == by[2]["origins"] != by[1]["origins"]
    assert sorted(map(tuple, duplicate_clusters(p.duplicate_edges(signatures)).collect())) == [(0, 0), (0, 2), (5, 5), (5, 6)]


def test_values_of_repeated_and_of_very_large_sets(monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(-(1 << 63), 1 << 63, 60)[rng.integers(0, 60, 5000)]
    bounds = np.array([0, 3, 3, 2000, 5000])
    family = H.coefficients(6)
    want = [brute(values[a:z].tolist(), family) for a, z in zip(bounds, bounds[1:])]
    for block, table in ((1 << 19, 1 << 25), (40, 200), (7, 64)):
        monkeypatch.setattr(H, "_BLOCK", block)
        monkeypatch.setattr(H, "_TABLE", table)
        got = H.minhash(values, bounds, family)
        assert got.tolist() == want and ((H.minhash(values, bounds, family, True) >> np.uint64(32)).astype(np.int64) == got).all()
