"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.sources.storage import materialize

EDGES_AT_ONCE = 1 << 20


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component in these edges, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(after, end, low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars with the same components: a task joins what it reads, about a million edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            u, v = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(side) for side in _joined(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= EDGES_AT_ONCE:
                yield stars()
        if held:
            yield stars()

    return edges.filter("u <> v").select("u", "v").mapInArrow(run, "u long, v long")


def slot(*keys: str) -> Column:
    """A function of the keys, to group by next to them.

    A join on the keys alone then exchanges the grouped side again, and with an
    exchange right below both sides adaptive execution can split a hot key.
    """
    return F.pmod(F.xxhash64(*keys), F.lit(1024)).alias("_slot")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u", slot("u")).agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges go from large to small."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u", slot("u")).agg(F.min("v").alias("m")).drop("_slot")
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node that has none, or is such a node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), "v"), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))))
    per_node = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("below"))
    return per_node.filter("low <> high OR (low IS NOT NULL AND below > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (``u, v``): the smallest node it reaches.

    Each task first joins the edges it reads. Each round is written to the shared folder,
    which cuts lineage and survives lost executors. The number of rounds grows with the
    logarithm of the longest path; the last one is known by its result, which is stars only.
    """
    current = materialize(_contracted(edges), "edges")
    while not _stars_only(current):
        current = materialize(_small_star(_large_star(current)), "edges")
    edges = current.distinct()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
