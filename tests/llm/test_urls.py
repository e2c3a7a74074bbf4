import random

import pytest

from quern.llm import urls as U

ENTRIES = [("block", "a.com"), ("allow", "b.a.com"), ("block", "b.a.com/x"), ("allow", "b.a.com/x/y"), ("block", "c.org/p"), ("allow", "d.net"), ("block", "d.net"), ("nonsense", "e.net"), ("block", ""), (None, "f.net"), ("block", None), ("block", "a.com"), ("block", "g.net/login"), ("allow", "h..net"), ("block", "A.com/Q"), ("block", "a.com/Q/"), ("allow", "i.net."), ("allow", "I.net")]


def brute(url):
    """Every entry against every URL, by string comparison."""
    import re

    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)[^/?#]*([^?#]*)", url or "")
    if not m or not m[1]:
        return None
    host, path = m[1].lower().removesuffix("."), [x for x in m[2].split("/") if x]
    best = None
    for action, entry in ENTRIES:
        if action not in ("allow", "block") or not entry:
            continue
        name, _, rest = entry.partition("/")
        rest = [x for x in rest.split("/") if x]
        name = name.lower().removesuffix(".")
        hit = host == name and path[: len(rest)] == rest if rest else host == name or host.endswith("." + name)
        if hit:
            mine = (-name.lower().removesuffix(".").count(".") - len(rest), action == "allow", entry)
            best = min(best or mine, mine)
    return best and ("allow" if best[1] else "block", best[2])


def some_urls():
    rng = random.Random(2)
    hosts = ["a.com", "b.a.com", "z.b.a.com", "c.org", "www.c.org", "d.net", "e.net", "f.net", "xa.com", "A.COM.", "u:p@a.com:80", "", "g.net", "login..g.net", "h..net", "x.h..net", "h.net", "i.net", ".", "..a.com"]
    paths = ["", "/", "/x", "/x/y", "/x//y/z", "/xy", "/p", "/p/", "/p?q=/x", "/x/y#f", "/é", "/login", "//login", "/Q/r"]
    return [f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(1500)] + [None, "", "a.com/x", "/x", "mailto:x@a.com", "http://", "http://a.com/" + "x/" * 5000]


@pytest.mark.parametrize("limit", [1000, 0])
def test_longest_match_equals_brute_force(spark, limit):
    urls = some_urls()
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)], "page_id long, url string, key string, row int")
    got = {r["page_id"]: (r["action"], r["entry"]) for r in U.judge(pages, spark.createDataFrame(ENTRIES, "action string, entry string"), limit).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == (brute(u) or (None, None)), u


def test_empty_tables_repeats_and_null_ids(spark):
    entries = spark.createDataFrame(ENTRIES, "action string, entry string")
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), entries).count() == 0
    pages = spark.createDataFrame([(None, "http://a.com"), (1, "http://a.com"), (1, "http://a.com")], "page_id long, url string")
    assert [r["action"] for r in U.judge(pages, entries).collect()] == ["block"] * 3
    for limit in (0, 10):
        assert {r["action"] for r in U.judge(pages, entries.limit(0), limit).collect()} == {None}
