"""Connected components of an edge table, by alternating large-star and small-star contraction.

Every step is a shuffle on the node; no step gathers a component in one place.
The number of rounds grows with the logarithm of the longest path. Up to
``ONE_TASK`` edges, whose size is known then, a single task does all rounds in
memory, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import observed, written

ONE_TASK = 2_000_000  #: edges (32 MB) that one task may hold


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, least node of the component of each)`` of edges between integers, by propagation of the least label and halving of paths."""
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    up = np.arange(len(nodes))
    while len(a):
        least = np.minimum(up[a], up[b])
        new = up.copy()
        np.minimum.at(new, up[a], least)
        np.minimum.at(new, up[b], least)
        while not np.array_equal(jump := new[new], new):
            new = jump
        up = new
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            nodes, least = forest(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, component long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges are (larger u, smaller v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "i", dst: str = "j", one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another; the component is its least node.

    Null ends, self edges and repeated edges are ignored; an empty table gives an empty one.
    """
    a, b = F.col(src), F.col(dst)
    mark = {"n": F.count("*"), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    first = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    now, before = observed(first, "edges", **mark)
    if before["n"] <= one_task:
        return written(_in_one_task(now), "components", [now])
    while before["n"]:
        now, after = observed(_small_star(_large_star(now)), "edges", [now], **mark)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
