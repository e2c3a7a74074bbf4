"""URL filter: a trie over reversed host labels and path segments, longest match between allow and block entries.

An entry is a host, which covers the host and all its subdomains, or a host
with a path, which covers that host alone and every path that begins with the
entry's segments. Of the entries that cover a URL the one with most host labels
and path segments decides; if it is listed both ways, block wins. Ports,
user names, queries, fragments, empty segments and a final dot of the host do
not count; hosts compare in lower case, paths as written.

A list of at most ``BROADCAST_ENTRIES`` entries and ``BROADCAST_BYTES`` bytes is
broadcast as a trie (some 40 MB at most in each worker: a node for every label
and segment); a longer one is joined on the prefixes of each URL, with the same
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import table

BROADCAST_ENTRIES, BROADCAST_BYTES = 50_000, 4 << 20

#: (action, entry) of the production list.
ENTRIES = [
    ("block", "spam-farm.example.org"),
    ("block", "cheap-pills.example.com"),
    ("allow", "cheap-pills.example.com/fr"),
    ("allow", "www.cheap-pills.example.com/en"),
    ("block", "www.cheap-pills.example.com/en/6"),
    ("block", "example.net/login"),
    ("block", "tionsh.example.net/de"),
    ("allow", "tionsh.example.net"),
    ("block", "blog.ththan.example.net"),
    ("allow", "blog.ththan.example.net/en"),
    ("block", "blog.ththan.example.net/en/569"),
    ("block", "tionble.example.org/en"),
    ("block", "ththed.example.org"),
    ("allow", "example.org"),
]

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_REST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a final dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def path(url: Column) -> Column:
    """Path with single slashes, none at its end; empty for the root."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _REST, 1), "/+", "/"), "/$", "")


def _parts(entry: str) -> tuple[list[str], list[str]]:
    name, _, rest = entry.partition("/")
    return name.lower().removesuffix(".").split(".")[::-1], [x for x in rest.split("/") if x]


class Trie:
    """Nodes are dicts; a host ends, and its path begins, at the key ``"/"``, which no label or segment can be (an empty label can). Of the spellings of one entry the least is named."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.root: dict = {}
        for action, entry in entries:
            if action not in ("allow", "block") or not entry:
                continue
            labels, segments = _parts(entry)
            node = self.root
            for x in labels + (["/", *segments] if segments else []):
                node = node.setdefault(x, {})
            if None not in node or (node[None][0] == "allow", node[None][1]) > (action == "allow", entry):
                node[None] = (action, entry)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """``(action, entry)`` of the longest match."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                return best
            best = node.get(None, best)
        node = node.get("/")
        for segment in path.split("/")[1:] if node else ():
            node = node.get(segment)
            if node is None:
                break
            best = node.get(None, best)
        return best


def _by_trie(urls: DataFrame, trie: Trie) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.match(h, p) if h else None for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.string())], ["page_id", "url", "action", "entry"])

    return urls.select("page_id", "url", "host", "path").mapInArrow(run, "page_id long, url string, action string, entry string")


def _by_join(urls: DataFrame, entries: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.lower(F.split_part("entry", F.lit("/"), F.lit(1))), r"\.$", "")
    rest = F.expr("regexp_replace(regexp_replace(substring(entry, length(split_part(entry, '/', 1)) + 1), '/+', '/'), '/$', '')")
    listed = entries.where("action in ('allow', 'block') and entry <> ''").select("action", "entry", name.alias("name"), rest.alias("rest"))
    listed = listed.select("action", "entry", F.concat(F.when(F.col("rest") == "", "h:").otherwise("p:"), "name", "rest").alias("key"), (F.size(F.split("name", r"\.")) + F.size(F.split("rest", "/")) - 1).alias("depth"))
    first = F.min_by(F.struct("action", "entry"), F.struct(F.col("action") == "allow", "entry"))
    listed = listed.groupBy("key", "depth").agg(first.alias("x")).select("key", "depth", "x.*")
    keys = F.expr("""concat(
        transform(sequence(1, size(labels)), i -> concat('h:', array_join(slice(labels, i, size(labels) - i + 1), '.'))),
        if(path = '', array(), transform(sequence(2, size(split(path, '/'))), i -> concat('p:', host, array_join(slice(split(path, '/'), 1, i), '/')))))""")
    keyed = urls.where("host <> ''").withColumn("labels", F.split("host", r"\.")).select("row", F.explode(keys).alias("key"))
    best = keyed.join(listed, "key").groupBy("row").agg(F.max_by(F.struct("action", "entry"), F.struct("depth", "action")).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "url", "best.action", "best.entry")


def judge(pages: DataFrame, entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(page_id, url, action, entry)`` for every row: the action of the longest match and the entry it came from, both null where no entry covers the URL.

    Null, empty and relative URLs are covered by no entry. Entries that are null, empty or of another action
    count as absent; repeated ones count once. page_id is passed through, null or repeated. Of the spellings of one
    entry the least is named.
    """
    urls = pages.select(F.col("page_id").cast("long"), "url").select("page_id", "url", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce(path(F.col("url")), F.lit("")).alias("path"))
    listed = entries.select("action", "entry").where("action is not null and entry is not null").distinct()
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= broadcast_entries and size["bytes"] <= broadcast_bytes:
        return _by_trie(urls, Trie([tuple(r) for r in listed.collect()]))
    return _by_join(urls.withColumn("row", F.monotonically_increasing_id()), listed)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, action, entry)`` of every page, by the production list."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(ENTRIES, "action string, entry string"))


SQL = f"""
WITH entries(action, entry) AS (VALUES {", ".join(f"('{a}', '{e}')" for a, e in ENTRIES)}),
listed AS (SELECT action, entry, split_part(entry, '/', 1) AS name, entry[strpos(entry || '/', '/'):] AS rest FROM entries),
urls AS (
  SELECT row_number() OVER () AS n, page_id, url, regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '\\.$', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(url, '{_REST}', 1), '/+', '/', 'g'), '/$', '') AS path
  FROM pages
), best AS (
  SELECT n, arg_max({{'a': l.action, 'e': l.entry}}, {{'d': len(string_split(l.name, '.')) + len(string_split(l.rest, '/')), 'a': l.action}}) AS b
  FROM urls u JOIN listed l ON CASE WHEN l.rest = '' THEN u.host = l.name OR ends_with(u.host, '.' || l.name) ELSE u.host = l.name AND (u.path = l.rest OR starts_with(u.path, l.rest || '/')) END
  GROUP BY n
)
SELECT page_id, url, b.a AS action, b.e AS entry FROM urls LEFT JOIN best USING (n)
"""
