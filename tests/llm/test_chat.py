import itertools
import math
import random
from collections import Counter

import numpy as np

from quern.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for t, role in enumerate(roles):
            lines = [" ".join(word() for _ in range(rng.randint(3, 12))) + rng.choice(".?.") for _ in range(rng.randint(1, 3))]
            rows.append((c, t, role, "\n".join(lines)))
    return rows


def model(spark, rows):
    return C.train(C.conversation_turns(spark.createDataFrame(rows, SCHEMA)))


def test_viterbi_equals_all_paths(spark):
    hmm = model(spark, conversations(2, 20))
    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 4, 3, 0, 2]
    features = np.stack([rng.integers(0, n, sum(sizes)) for _, n in C.FEATURES], axis=1)
    bounds = np.cumsum([0, *sizes])
    got = hmm.viterbi(features, bounds)
    e = hmm.emission(features)
    for a, z in zip(bounds, bounds[1:]):
        if a == z:
            continue

        def score(path, a=a, z=z):
            return hmm.start[path[0]] + sum(hmm.step[p, q] for p, q in zip(path, path[1:])) + sum(e[a + i, s] for i, s in enumerate(path))

        best = max(score(p) for p in itertools.product(range(C.STATES), repeat=z - a))
        assert abs(score(got[a:z].tolist()) - best) < 1e-9


def test_held_out_roles_are_recovered_in_every_style(spark):
    hmm = model(spark, conversations(1, 80))
    rows = conversations(50, 60)
    right = {s: [0, 0] for s in range(len(C.STYLES))}
    for c in range(60):
        turns = [(r, t) for cc, _, r, t in rows if cc == c]
        for style in right:
            lines = "\n".join(C.laid_out(style, turns)[0]).split("\n")
            states = hmm.viterbi(C.observed(lines), np.array([0, len(lines)]))
            right[style][0] += C.turns_of(lines, states) == turns
            right[style][1] += 1
    for style, (ok, n) in right.items():
        assert ok >= (0.95 if C.STYLES[style] else 0.6) * n, (style, ok, n)


def test_render_and_markers():
    assert C.render([("user", "a\nb"), ("assistant", "")]) == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    for line, role in (("User: hi", 1), ("### Human:", 1), ("**AI:** x", 2), ("<|im_start|>system", 0), ("[Tool]", 3), ("Users: hi", None), ("Q: x", 1), ("Quite: x", None)):
        assert C.observed([line])[0, 0] == (0 if role is None else role + 1), line


def test_whole_operator_with_nulls_ties_and_clashing_columns(spark):
    rows = conversations(7, 30)
    odd = [(100, None, "user", "first"), (100, 1, None, None), (100, 1, "assistant", "x"), (100, 1, "assistant", "x"), (None, 0, "user", "alone"), (None, 1, "user", "alone too"), (101, 0, "poet", ""), (102, 0, "user", "word " * 50_000)]
    df = spark.createDataFrame([(*r, "s", [1]) for r in rows + odd], SCHEMA + ", style string, turns array<int>")
    got = C.format_conversations(df).collect()
    assert len(got) == 30 + 5
    assert {r["conv_id"] for r in got} == {*range(30), 100, 101, 102, None}
    assert all(r["rendered"].startswith("<|im_start|>") for r in got)
    assert C.format_conversations(df.limit(0)).count() == 0


def test_parse_of_null_and_empty_transcripts(spark):
    hmm = model(spark, conversations(3, 20))
    got = C.parse(spark.createDataFrame([(1, None), (2, ""), (2, "User: a\nAssistant: b")], "conv_id long, transcript string"), hmm).collect()
    assert got[0]["roles"] is None and got[0]["rendered"] is None
    assert len(got[1]["roles"]) == 1 and got[2]["roles"] == ["user", "assistant"]
    assert got[2]["rendered"] == C.render([("user", "a"), ("assistant", "b")])


def test_untrained_model_still_follows_markers(spark):
    hmm = model(spark, [])
    lines = ["System: be brief", "User: hi", "there", "Assistant: yo"]
    assert C.turns_of(lines, hmm.viterbi(C.observed(lines), np.array([0, 4]))) == [("system", "be brief"), ("user", "hi\nthere"), ("assistant", "yo")]


def plain(transcripts, labelled):
    """The whole operator by dictionaries: counts, probabilities, paths and rendering."""
    start, step, seen, n_seen, pooled = Counter(), Counter(), Counter(), Counter(), Counter()
    for lines, states in labelled:
        features = C.observed(lines)
        if lines and states[0] >= 0:
            start[states[0]] += 1
        for a, b in zip(states, states[1:]):
            step[a, b] += a >= 0 and b >= 0
        for s, f in zip(states, features.tolist()):
            for k, v in enumerate(f):
                if s >= 0:
                    seen[k, s, v] += 1
                    n_seen[k, s] += 1
                    pooled[k, v] += 1
    states = range(C.STATES)
    begins = [s for s in states if s % 2 == 0]

    def log(x):
        return math.log(x) if x > 0 else -math.inf

    first = {s: log((start[s] + 1) / sum(start[x] + 1 for x in begins)) if s in begins else -math.inf for s in states}
    allowed = {a: [b for b in states if b % 2 == 0 or b // 2 == a // 2] for a in states}
    move = {(a, b): log((step[a, b] + 1) / sum(step[a, x] + 1 for x in allowed[a])) if b in allowed[a] else -math.inf for a in states for b in states}

    def emit(s, f):
        total = 0.0
        for k, (name, values) in enumerate(C.FEATURES):
            if k == 0:
                weight = lambda v, s=s: seen[0, s, v] + 1 + (C.PRIOR if s % 2 == 0 and v == 1 + s // 2 else 0)
                p = weight(f[0]) / sum(weight(v) for v in range(values))
            else:
                every = (pooled[k, f[k]] + 1) / (sum(pooled[k, v] for v in range(values)) + values)
                p = (1 - C.POOLED[name]) * seen[k, s, f[k]] / n_seen[k, s] + C.POOLED[name] * every if n_seen[k, s] else every
            total += log(p)
        return total

    out = {}
    for conv, text in transcripts.items():
        lines = text.split("\n")
        features = C.observed(lines).tolist()
        best = {s: (first[s] + emit(s, features[0]), (s,)) for s in states}
        for f in features[1:]:
            best = {b: max(((v + move[a, b], path) for a, (v, path) in best.items()), key=lambda x: x[0]) for b in states}
            best = {b: (v + emit(b, f), (*path, b)) for b, (v, path) in best.items()}
        out[conv] = {C.render(C.turns_of(lines, np.array(path))) for v, path in best.values() if v >= max(x for x, _ in best.values()) - 1e-9}
    return out


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    turns = C.conversation_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    labelled = [C.laid_out(r["style"], [(t["role"], t["text"]) for t in r["turns"]]) for r in turns.collect()]
    transcripts = {r["conv_id"]: r["transcript"] for r in C.transcripts(turns).collect()}
    want = plain(transcripts, labelled)
    got = {r["conv_id"]: r["rendered"] for r in C.op8_chat_format(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[c] in want[c] for c in want)
