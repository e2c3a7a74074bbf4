"""The model against a slow one of dictionaries, pruning, bands and edge cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import perplexity as P

SCHEMA = "doc_id long, lang string, text string"


def words(rng, n, alphabet):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, "xx", words(rng, rng.randint(5, 40), "abcde")) for i in range(30)]
    out += [(100 + i, "yy", words(rng, rng.randint(5, 40), "fghij")) for i in range(30)]
    return out + [(200, "xx", out[0][2]), (201, "xx", None), (202, "yy", ""), (203, None, "ab cd"), (None, "xx", "abc abc"), (204, "yy", "  \n\t ")]


def brute(rows):
    """Mean negative log probabilities by the definition, with dictionaries and tuples."""
    out = {}
    for lang in {r[1] for r in rows}:
        docs = [r for r in rows if r[1] == lang]
        grams = []
        for _, _, text in docs:
            cp = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            s = P.symbols(cp, np.array([0, len(cp)]))[0].tolist()
            s = [P.START] * 4 + s
            grams.append([tuple(s[i : i + 5]) for i in range(len(s) - 4)])
        count, df = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
        table, kept = {5: count}, {5: {g for g in count if df[g] > 1}}
        for k in range(4, 0, -1):
            left = defaultdict(set)
            for g in table[k + 1]:
                left[g[1:]].add(g[0])
            table[k] = {g: len(x) for g, x in left.items()}
            kept[k] = {g for g in table[k] if table[k][g] > 1} | {g[1:] for g in kept[k + 1]}
        d = {k: P.discounts([sum(a == i for a in table[k].values()) for i in range(1, 5)]) for k in table}
        own = {k: {g: a - d[k][min(a, 3) - 1] for g, a in table[k].items()} for k in table}
        total = {k: Counter() for k in table}
        mass = {k: Counter() for k in table}
        for k in table:
            for g, a in table[k].items():
                total[k][g[:-1]] += a
                mass[k][g[:-1]] += own[k][g] if g in kept[k] else 0

        def p(g):
            k = len(g)
            if not k:
                return 1 / P.SYMBOLS
            c = g[:-1]
            if c not in total[k]:
                return p(g[1:])
            alpha = own[k][g] / total[k][c] if g in kept[k] else 0.0
            return alpha + (1 - mass[k][c] / total[k][c]) * p(g[1:])

        for r, g in zip(docs, grams):
            out[r] = -sum(math.log(p(x)) for x in g) / len(g) if g else None
    return out


def test_model_equals_brute_force(spark, rows):
    want = brute(rows)
    got = {(r["doc_id"], r["lang"]): r["nll"] for r in P.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[0], r[1]]
        assert (g is None) == (want[r] is None)
        assert g is None or abs(g - want[r]) < 1e-5


def model_of(spark, rows, entries=P.ENTRIES):
    return P.Model(P.interpolated(P.orders(P.count_grams(spark.createDataFrame(rows, SCHEMA))), entries))


def total(model, context):
    base = 0
    for c in context:
        base = base << P.BITS | ord(c)
    return np.exp(model.logp("xx", (base << P.BITS) + np.arange(P.SYMBOLS))).sum()


def test_probabilities_sum_to_one(spark, rows):
    model = model_of(spark, rows)
    for context in ("abcd", "zzzz", "e ab"):
        assert abs(total(model, context) - 1) < 1e-5


def test_a_model_beyond_its_size_is_pruned_from_the_rarest(spark, rows):
    whole = model_of(spark, rows)
    size = sum(len(keys) for keys, _ in whole.p.values())
    for entries in (size, size // 2, size // 5):
        model = model_of(spark, rows, entries)
        n = sum(len(keys) for keys, _ in model.p.values())
        assert n <= entries and (n == size) == (entries == size)
        assert all(np.isin(keys, whole.p[name][0]).all() for name, (keys, _) in model.p.items())
        for context in ("abcd", "e ab"):
            assert abs(total(model, context) - 1) < 1e-5


def test_slices_of_a_large_model_score_as_the_whole_does(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r["lang"] or "", r["doc_id"] or 0, r["n"], r["nll"] or 0) for r in P.scores(docs).collect())
    whole = P.interpolated(P.orders(P.count_grams(docs)))
    size = whole.count()
    for entries in (size // 2, size // 10, 40):
        cut = P.slices(whole, entries)
        seen = {tuple(g) for *_, part in cut for g in part.select("lang", "k", "g").collect()}
        assert len(cut) > size // entries * 0.9 and len(seen) == size
        got = sorted((r["lang"] or "", r["doc_id"] or 0, r["n"], r["nll"] or 0) for r in P.scores(docs, entries).collect())
        assert got == want, entries


def test_query_equals_brute_force_and_catches_junk(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    scored = P._with_bands(spark.createDataFrame([(*r[:2], len(r[2]), want[r]) for r in docs], P._SCORES)).collect()
    kept = {r["doc_id"]: math.exp(r["nll"]) for r in scored if r["nll"] is not None and -P.LOWER <= r["z"] <= P.UPPER}
    got = {r["doc_id"]: r["perplexity"] for r in P.op1_ngram_perplexity(spark, sf).collect()}
    assert len(got) > 190 and len(set(got) ^ set(kept)) <= 1 and all(abs(got[i] - kept[i]) < 1e-3 for i in set(got) & set(kept))


def test_bands_are_fitted_to_each_side_of_each_language(spark):
    rng = random.Random(4)
    rows = [(i, lang, 4000, 2.0 + (up * x if (x := abs(rng.gauss(0, 1))) and i % 2 else -down * x)) for lang, down, up in (("xx", 0.1, 0.02), ("yy", 0.03, 0.3)) for i in range(2000)]
    z = {}
    for r in P._with_bands(spark.createDataFrame(rows, P._SCORES)).collect():
        z.setdefault((r["lang"], r["z"] < 0), []).append(abs(r["z"]))
    assert len(z) == 4 and all(0.9 < np.std([*v, *(-x for x in v)]) < 1.1 for v in z.values())


def test_a_very_long_text(spark):
    text = "abcd efgh " * 200_000
    got = P.judge(spark.createDataFrame([(1, "xx", text), (2, "xx", text[:5000]), (3, "xx", "zz")], SCHEMA)).collect()
    assert len(got) == 3 and next(r["perplexity"] for r in got if r["doc_id"] == 1) < 2


def test_bands_reject_both_sides_and_keep_the_rest(spark):
    rng = random.Random(1)
    lexicon = [words(rng, 1, "abcdefgh") for _ in range(60)]
    rows = [(i, "xx", " ".join(rng.choices(lexicon, k=120))) for i in range(120)]
    rows += [(900, "xx", "".join(chr(rng.randint(0x21, 0x7A)) for _ in range(700))), (901, "xx", "aa " * 400), (902, "xx", None), (903, "xx", "")]
    got = {r["doc_id"]: r for r in P.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert not any(got[i]["keep"] for i in (900, 901, 902, 903))
    assert got[900]["z"] > P.UPPER and got[901]["z"] < -P.LOWER and got[902]["perplexity"] is None
    assert sum(got[i]["keep"] for i in range(120)) == 120


def test_empty_table_repeats_and_extra_columns(spark):
    assert P.judge(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "xx", "abc def", "p", 1), (1, "xx", "abc def", "q", 2)]
    got = P.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string, z string, keep int")).collect()
    assert len(got) == 2 and got[0]["perplexity"] == got[1]["perplexity"]


def test_symbols_collapse_white_space_per_row():
    text = pa.array(["A \t b", " x", "9ß"])
    (_, _, cp, off), = P.chunks(text)
    s, o = P.symbols(cp, off)
    assert s[o[0] : o[1]].tolist() == [97, 32, 98] and s[o[1] : o[2]].tolist() == [32, 120] and s[o[2] :].tolist() == [48, 223]


def test_discounts_fall_back():
    assert P.discounts([0, 1, 1, 1]) == (0.5, 1.0, 1.5)
    d = P.discounts([100, 40, 20, 12])
    assert 0 < d[0] < d[1] < d[2] < 3
