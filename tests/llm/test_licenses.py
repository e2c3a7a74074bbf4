import random
import textwrap

from quern.llm import licenses as L

MIT, APACHE = L.TEMPLATES[2][1], "Licensed under the Apache License, Version 2.0."


def found(text):
    return [(name, text[a:z], missing, extra) for a, z, name, _, missing, extra in L.Scanner(L.TEMPLATES).scan(text)]


def edit_distance(a, b):
    """Least edits from all of a to any part of b, by recursion over prefixes."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_differences_are_the_least_edits():
    rng = random.Random(4)
    for _ in range(150):
        a, b = rng.choices("abcde", k=rng.randint(1, 9)), rng.choices("abcde", k=rng.randint(0, 14))
        first, end, missing, extra = L.differences(a, b)
        left = list(b[first:end])
        assert max(len(missing), len(extra)) <= edit_distance(a, b) <= len(missing) + len(extra)
        for w in extra:
            left.remove(w)
        rest = list(a)
        for w in missing:
            rest.remove(w)
        assert sorted(left) == sorted(rest)


def test_every_template_is_found_verbatim_and_wins():
    for name, template in L.TEMPLATES:
        hits = found(f"Some prose before.\n{template}\nSome prose behind.")
        assert any(n == name and not m and not e for n, _, m, e in hits), (name, template, hits)


def test_edited_wording_is_reported_and_versions_are_not_confused():
    (name, text, missing, extra), = found("Intro.\n" + MIT.replace("free of charge", "without charge").replace("persons", "people"))
    assert name == "MIT" and missing == ["free", "of", "persons"] or (sorted(missing), sorted(extra)) == (["free", "of", "persons"], ["people", "without"])
    assert [n for n, *_ in found("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 7.") == []


def test_prose_and_cues_alone_give_nothing():
    assert found("A driving licence is required. Copyright law is hard. There is no warranty on this toaster.") == []
    assert found("") == [] and found("\n\n") == []


def names(text):
    return [n for n, _, _, _ in found(text)]


def test_two_licenses_long_lines_and_other_layout():
    got = names("x y z. " * 30_000 + APACHE + " " + "more prose here. " * 200 + "All rights reserved.")
    assert got == ["Apache-2.0", "all-rights-reserved"]
    got = names(f"{APACHE}\nReleased under the MIT License.")
    assert sorted(got) == ["Apache-2.0", "MIT"]
    wrapped = MIT.replace("software and", "software\nand").replace("without restriction", "WITHOUT\n  RESTRICTION")
    exact = [n for n, _, m, e in found(wrapped) if not m + e]
    assert exact == ["MIT"]


def test_saved_bytes_rank_the_right_template_first():
    s = L.Scanner(L.TEMPLATES)
    for name, template in L.TEMPLATES:
        ranked = s.ranked(template)
        assert ranked and s.templates[ranked[0][1]][0].split("-")[0] == name.split("-")[0]


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, APACHE, "s", 5), (1, APACHE, "s", 5), (None, APACHE, None, None), (2, None, "s", 1), (3, "", "s", 1), (4, "nothing", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    got = [(r["doc_id"], r["license"], r["start"], r["end"]) for r in L.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "Apache-2.0", 0, 46), (1, "Apache-2.0", 0, 46), (None, "Apache-2.0", 0, 46)], key=str)
    assert L.scan(df.limit(0)).count() == 0 and L.scan(df, []).count() == 0


def test_every_template_is_found_wrapped_in_comments_and_in_long_lines():
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    plain = lambda t: L._WORD.findall(t.lower())
    for name, template in L.TEMPLATES:
        texts = [f"{prose(900)}. {template} {prose(900)}."]
        for width in (20, 33, 50, 79):
            for mark in ("", "# ", " * ", "// "):
                body = "\n".join(mark + x for x in textwrap.wrap(f"{template}", width, break_long_words=False, break_on_hyphens=False))
                texts.append(f"{mark}{prose(9)}\n{mark}\n{body}\n{mark}\n{prose(300)}\n{prose(9)}")
        for text in texts:
            assert [(n, plain(t), m, e) for n, t, m, e in found(text)] == [(name, plain(template), [], [])], (name, text)


def test_every_place_of_repeated_and_nested_wording_is_found():
    assert names("a: Released under the MIT License. / b: Released under the MIT License.") == ["MIT"] * 2
    assert names("\n".join(f"(c) {y} Someone. All rights reserved." for y in range(2000, 2007))) == ["all-rights-reserved"] * 7
    long = L.TEMPLATES[4][1]
    hits = [t for _, t, _, _ in found(f"{long}\nThe rest: {APACHE}\n{long}")]
    assert [len(t) for t in sorted(hits, key=len)] == [len(APACHE) - 1, len(long), len(long)]
    # many, over several windows, among them places that share words with no other
    many = found("".join(f"p{i}: {APACHE} q{i}: Released under the MIT License.\n" for i in range(1_500)))
    assert sorted(n for n, *_ in many) == ["Apache-2.0"] * 1_500 + ["MIT"] * 1_500
    assert len(found(f"{MIT}\n\n" * 90)) == 90
    # the second place lacks its first word: it is found in what the first one leaves
    words = L.TEMPLATES[1][1].split()
    assert names(" ".join(words + words[1:])) == ["MIT"] * 2
