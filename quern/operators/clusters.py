"""Clusters of duplicates, their representatives and sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components


def duplicate_clusters(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """``(cluster_id, doc_idx)``: connected components of ``(i, j)`` with at least ``min_size`` members, named by the least."""
    if min_size < 2:
        raise ValueError(f"a cluster has at least two members, not {min_size}")
    members = connected_components(edges).select(F.col("component").alias("cluster_id"), F.col("node").alias("doc_idx"))
    if min_size == 2:
        return members
    large = members.groupBy("cluster_id").count().where(F.col("count") >= min_size).select("cluster_id")
    return members.join(large, "cluster_id", "left_semi")


def size_histogram(clusters: DataFrame) -> DataFrame:
    """``(size, n_clusters)``."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_clusters"))


def giant_clusters(clusters: DataFrame, most: int) -> DataFrame:
    """``(cluster_id, size)`` of the clusters of more than ``most`` members: chains and boilerplate to look at before they count."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") > most)


def without_giants(clusters: DataFrame, most: int) -> DataFrame:
    """The clusters of at most ``most`` members. The others' documents count as unique then and all stay."""
    return clusters.join(giant_clusters(clusters, most).select("cluster_id"), "cluster_id", "left_anti")


def representatives(clusters: DataFrame, lengths: DataFrame | None = None, strategy: str = "longest", seed: int = 42) -> DataFrame:
    """``(cluster_id, doc_idx)``, the one to keep of each cluster: the first, the longest (``lengths`` has doc_idx and length; ties to the first), or one drawn by a hash of seed and index."""
    if strategy == "first":
        return clusters.groupBy("cluster_id").agg(F.min("doc_idx").alias("doc_idx"))
    if strategy == "longest":
        rank: Column = F.struct(-F.col("length"), F.col("doc_idx"))
        clusters = clusters.join(lengths.select("doc_idx", "length"), "doc_idx")
    elif strategy == "random":
        rank = F.struct(F.xxhash64(F.lit(seed), F.col("doc_idx")), F.col("doc_idx"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return clusters.groupBy("cluster_id").agg(F.min_by("doc_idx", rank).alias("doc_idx"))


def dropped_ids(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(doc_idx)`` of the cluster members that aren't representatives."""
    return clusters.select("doc_idx").join(chosen.select("doc_idx"), "doc_idx", "left_anti")


def survivors(docs: DataFrame, clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` outside all clusters, and the representatives, as they are."""
    return docs.join(dropped_ids(clusters, chosen), "doc_idx", "left_anti")


def pairs_within(clusters: DataFrame) -> DataFrame:
    """``(i, j)``, i < j: all pairs of members of a cluster, quadratic in its size. To count them against true pairs :func:`quern.operators.evaluate.cluster_confusion` needs no list."""
    a, b = clusters.alias("a"), clusters.alias("b")
    return a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.doc_idx") < F.col("b.doc_idx"))).select(F.col("a.doc_idx").alias("i"), F.col("b.doc_idx").alias("j"))


class UnionFind:
    """Disjoint sets on the driver, for pair lists that fit there; grows as elements are named."""

    def __init__(self, n: int = 0):
        self._up = list(range(n))
        self._rank = [0] * n

    @classmethod
    def from_pairs(cls, pairs: Iterable[tuple[int, int]], n: int = 0) -> UnionFind:
        out = cls(n)
        for i, j in pairs:
            out.union(i, j)
        return out

    def find(self, x: int) -> int:
        if x < 0:
            raise ValueError(f"elements count from 0, not {x}")
        while len(self._up) <= x:
            self._up.append(len(self._up))
            self._rank.append(0)
        root = x
        while self._up[root] != root:
            root = self._up[root]
        while self._up[x] != root:
            self._up[x], x = root, self._up[x]
        return root

    def union(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self._rank[x] < self._rank[y]:
            x, y = y, x
        self._up[y] = x
        self._rank[x] += self._rank[x] == self._rank[y]
        return True

    def connected(self, x: int, y: int) -> bool:
        return self.find(x) == self.find(y)

    @property
    def num_elements(self) -> int:
        return len(self._up)

    @property
    def num_components(self) -> int:
        return sum(self._up[x] == x for x in range(len(self._up)))

    def clusters(self, min_size: int = 1) -> list[list[int]]:
        """Sorted members of every set of at least that size, by their least."""
        sets: dict[int, list[int]] = {}
        for x in range(len(self._up)):
            sets.setdefault(self.find(x), []).append(x)
        return sorted(s for s in sets.values() if len(s) >= min_size)
