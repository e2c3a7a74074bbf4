import random

import numpy as np
import pyarrow as pa

from quern.llm import decontaminate as D
from quern.llm.text import Words, chunks

SCHEMA = "doc_id long, text string"


def words_of(text):
    (_, _, cp, off), = chunks(pa.array([text]))
    return Words(cp, off).hash


def brute_score(item, passage):
    """Local alignment, cell by cell."""
    row, best = [0] * (len(passage) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(passage, 1):
            new.append(max(0, row[j - 1] + (D.MATCH if x == y else -D.OTHER), row[j] - D.OTHER, new[-1] - D.OTHER))
        row = new
        best = max(best, *row)
    return best


def test_smith_waterman_equals_brute_force():
    rng = np.random.default_rng(2)
    items = [rng.integers(2, 7, rng.integers(1, 12)).astype(np.uint64) for _ in range(120)]
    passages = [rng.integers(2, 7, rng.integers(1, 40)).astype(np.uint64) for _ in range(120)]
    assert D.smith_waterman(items, passages).tolist() == [brute_score(i.tolist(), p.tolist()) for i, p in zip(items, passages)]


def prose(rng, n, lexicon):
    return " ".join(rng.choices(lexicon, k=n))


def corpus(seed=1):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 8))) for _ in range(2500)]
    items = [(i, prose(rng, rng.randint(8, 60), lexicon)) for i in range(25)]
    docs, truth = [], set()
    for d in range(150):
        text = prose(rng, rng.randint(30, 300), lexicon)
        if d % 3 == 0:
            i, item = rng.choice(items)
            w = item.split()
            if d % 2:
                for _ in range(len(w) // 8):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [rng.choice(lexicon)], [w[at], rng.choice(lexicon)]])
            text = f"{text} {' '.join(w).upper()}, {prose(rng, 20, lexicon)}"
            truth.add((d, i))
        docs.append((d, text))
    return docs, items, truth


def test_exact_and_edited_copies_are_found_and_nothing_else(spark):
    docs, items, truth = corpus()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items if brute_score(words_of(x).tolist(), words_of(t).tolist()) >= D.THRESHOLD * D.MATCH * len(words_of(x))}
    assert truth <= want and len(got.keys() & want) >= 0.97 * len(want) and set(got) <= want
    assert all(got[p] == 1.0 for p in truth if p[0] % 2 == 0)


def test_an_item_copied_everywhere_is_found(spark):
    rng = random.Random(3)
    lexicon = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(500)]
    item = prose(rng, 30, lexicon)
    docs = [(d, f"{prose(rng, 50, lexicon)} {item}") for d in range(200)]
    assert D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 200


def test_slices_give_the_same_result(spark, monkeypatch):
    docs, items, _ = corpus(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "SLICE_WORDS", 200)
    assert sorted(map(tuple, D.contaminated(d, b).collect())) == once and once
    kept = {r["doc_id"] for r in D.without_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in once}


def test_edge_cases(spark):
    item = "one two three four five six seven eight"
    rows = [(1, f"x {item} y", "a", 1.0), (1, f"x {item} y", "a", 1.0), (None, item, None, None), (2, None, "b", 0.0), (3, "", "b", 0.0), (4, "one two three", "b", 0.0), (5, "filler " * 200_000 + item, "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1), (10, "too short", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    got = D.contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"] or -1, r["item_id"] or -1) for r in got)) == sorted([(d, i) for d in (1, 1, -1, 5) for i in (7, 7, -1)])
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0
    assert D.without_contaminated(docs, bench.limit(0)).count() == len(rows) and D.without_contaminated(docs.limit(0), bench).count() == 0


def with_every_fourth_replaced(item, rng, lexicon, first):
    w = item.split()
    w[first::4] = rng.choices(lexicon, k=len(w[first::4]))
    return " ".join(w)


def test_edited_and_partial_copies_are_found_however_many_and_in_small_tables(spark):
    rng = random.Random(9)
    lexicon = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(2500)]
    item = prose(rng, 20, lexicon)
    edited = with_every_fourth_replaced(item, rng, lexicon, 1)
    half = " ".join(item.split()[10:])
    plain = [prose(rng, 40, lexicon) for _ in range(300)]
    tables = {
        "hot edited copy": plain + [f"{prose(rng, 40, lexicon)} {edited}" for _ in range(60)],
        "hot item, partial and edited copies": plain + [f"{prose(rng, 40, lexicon)} {item}" for _ in range(60)] + [f"{half} {prose(rng, 40, lexicon)}", f"x y z {edited}", with_every_fourth_replaced(item, rng, lexicon, 2)],
        "few rows": plain[:20] + [f"{prose(rng, 40, lexicon)} {edited}"],
    }
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, texts in tables.items():
        got = {r["doc_id"]: r["score"] for r in D.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
        scores = {d: brute_score(words_of(item).tolist(), words_of(t).tolist()) / (D.MATCH * 20) for d, t in enumerate(texts)}
        assert got == {d: s for d, s in scores.items() if s >= D.THRESHOLD} and got, name


def test_pieces_of_a_chunk_give_the_same_result(monkeypatch):
    docs, items, _ = corpus(4)
    it = D.Items(*zip(*items))
    (_, _, cp, off), = chunks(pa.array([t for _, t in docs]))
    once = [x.tolist() for x in D.aligned(it, Words(cp, off))]
    monkeypatch.setattr(D, "POSTINGS", 3)
    assert [x.tolist() for x in D.aligned(it, Words(cp, off))] == once and once[0]


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "今天天气很好我们一起去公园散步看花然后回家吃饭休息吧"
    items = [(1, chinese), (2, "who wrote this book"), (3, "Paris"), (4, "name the capital")]
    docs = [
        (1, f"前言{chinese}后记"),
        (2, "他说" + chinese[:8] + "不" + chinese[9:] + "。"),
        (3, chinese[:6] + "别的话完全没有关系"),
        (4, "well, who wrote this book? nobody"),
        (5, "who wrote this long book"),
        (6, "Paris!"),
        (7, "in Paris it rains"),
        (8, "Now name the capital."),
        (9, "name the river"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(df, bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 3), (8, 4)}
    assert {r["doc_id"] for r in D.without_contaminated(df, bench).collect()} == {3, 5, 7, 9}
