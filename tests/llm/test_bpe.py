import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import bpe as B

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    pool = ["don't", "I'll", "we've", "x's", "'s", "''", "naïve", "straße", "日本語", "\U0001f600\U0001f680", "1234567", "v2.0", "a" * 300, "!?!?", " ", "\t", "\n\n", "  ", "   x", "é", " ", "_", "foo_bar", "'re", "'", "ﬁ", "\x00", "\x1c"]
    out = ["", " ", "   ", "\n", "a", "'", "the quick brown fox's  jumps\n\n  over 12 dogs.  "]
    out += ["".join(rng.choice(pool) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return out + ["ab" * 40_000, "x " * 30_000]


def reference(texts):
    import public_tokenizers
    import tiktoken

    import base64

    with open(B.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t) for t in texts]


def test_ids_equal_a_public_tokenizer(spark, texts):
    got = {r["doc_id"]: r for r in B.encode(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, want in enumerate(reference(texts)):
        assert got[i]["tokens"] == want, texts[i][:100]
        assert got[i]["n_tokens"] == len(want) and got[i]["round_trip"]


def test_decoding_gives_the_texts_back(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["text"] for r in B.decode(B.encode(df)).collect()}
    assert got == dict(enumerate(texts))


def brute(v, word):
    """Merge the leftmost pair of least rank, looking at all pairs every time."""
    ids = v.of_byte[np.frombuffer(word, np.uint8)].tolist()
    while True:
        ranks = [(v.pairs.get(a << 20 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return ids
        r, i = min(ranks)
        ids[i : i + 2] = [r]


def test_trees_equal_brute_force():
    v, rng = B.Vocabulary(), random.Random(8)
    words = [bytes(rng.choices(b"etaoinshr lab\xc3\xa9", k=rng.randint(1, 33))) for _ in range(400)] + [b"aaaaaaaaaaaaaaaa", b"ababababab"]
    for w in words:
        assert B.merge_one(v, w) == brute(v, w)
    m = max(map(len, words))
    table = np.zeros((len(words), m), np.uint8)
    for i, w in enumerate(words):
        table[i, : len(w)] = np.frombuffer(w, np.uint8)
    ids, n = B.merge_forest(v, table, np.array([len(w) for w in words]))
    assert [x for w in words for x in brute(v, w)] == ids.tolist() and n.sum() == len(ids)


def test_nulls_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "ab", "t"), (1, "ab", "t"), (None, "ab", None), (2, None, "t"), (3, "", "t")], "doc_id long, text string, tokens string")
    got = sorted(((r["doc_id"] or -1, r["tokens"], r["n_tokens"], r["round_trip"]) for r in B.encode(df).collect()), key=lambda r: r[0])
    ab = got[0][1]
    assert got == [(-1, ab, 1, True), (1, ab, 1, True), (1, ab, 1, True), (2, None, None, None), (3, [], 0, True)]
    back = B.decode(spark.createDataFrame([(1, None), (2, []), (3, [160])], "doc_id long, tokens array<int>")).collect()
    assert [(r["doc_id"], r["text"]) for r in sorted(back)][:2] == [(1, None), (2, "")]
    assert B.encode(df.limit(0)).count() == 0
