"""Merkle manifest of a dataset: leaves, subtree roots, proofs and their verification.

Rows are leaves of the tree of their ``tree_col`` value, in the order of their ids;
the roots of these trees are the leaves of one more tree. A node is the digest of up
to ``FANOUT`` consecutive nodes below it. A superblock is ``FANOUT ** LEVELS``
consecutive nodes, so it reduces to one node on its own. Roots of superblocks are
numbered like leaves and reduced in the next round, until each tree has one node.
On the way back every superblock meets the nodes outside it that its proofs need (a
few dozen digests) in a cogroup, which reduces the superblock again, joins its inner
siblings to the outer ones and folds each claimed leaf up to the root.

No task holds more than a superblock, whatever the share of a tree in the table. Order
comes from range partitions that are sorted locally and counted.

Defined cases: null fields are ``-``; a null ``tree_col`` is a tree of its own and the
first; rows without id come first in their tree; rows that repeat an id are leaves each,
in the order of their digests; very long texts are hashed where they are read; a
tree of one leaf has that leaf as root and no inner siblings; an empty table gives an
empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.components import slot
from runlens.sources.storage import materialize

FANOUT = 8
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "roots"
_PATH = "tree string, place long, lefts array<string>, rights array<string>, subroot string, root string"
_PROVEN = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "lefts array<string>, rights array<string>"
)


# --- inside one superblock ---------------------------------------------------------


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def spanned(n: int, levels: int = LEVELS) -> int:
    """Levels that a superblock of a tree of ``n`` nodes has."""
    found = 0
    while n > 1 and found < levels:
        n, found = -(-n // FANOUT), found + 1
    return found


def nodes_after(n: int, levels: int = LEVELS) -> int:
    for _ in range(spanned(n, levels)):
        n = -(-n // FANOUT)
    return n


def reduced(digests: Sequence[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the digests themselves to ``levels`` above them."""
    found = [list(digests)]
    for _ in range(levels):
        below = found[-1]
        found.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return found


def siblings(nodes: Sequence[str]) -> list[tuple[str, str]]:
    """For each node, the others of its run that stand left and right of it."""
    found = []
    for i in range(0, len(nodes), FANOUT):
        run = nodes[i : i + FANOUT]
        found += [("".join(run[:j]), "".join(run[j + 1 :])) for j in range(len(run))]
    return found


def paths(digests: Sequence[str], levels: int) -> list[list[tuple[str, str]]]:
    """For each node, its siblings level by level inside the superblock."""
    beside = [siblings(nodes) for nodes in reduced(digests, levels)[:levels]]
    return [[level[i // FANOUT**k] for k, level in enumerate(beside)] for i in range(len(digests))]


def folded(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


# --- rounds over a table of nodes ----------------------------------------------------


def _numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0 in each ``tree`` by ``order``) and ``n``, the tree's nodes."""
    ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    laid = materialize(
        ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "nodes"
    )
    runs = laid.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(Window.partitionBy("tree").orderBy("part")) - F.col("own")
    shifts = runs.select(
        "tree", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(Window.partitionBy("tree")).alias("n")
    )
    return (
        laid.join(shifts, ["tree", "part"])
        .withColumn("place", F.col("row") + F.col("shift"))
        .drop("part", "row", "shift")
    )


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / FANOUT**levels).cast("long").alias("block")


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``tree, place, n, digest`` of the nodes, then of the superblocks' roots, round by round."""

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iat[0])
        ordered = block.sort_values("place")
        root = reduced(ordered["digest"].tolist(), spanned(n, levels))[-1]
        return pd.DataFrame(
            {
                "tree": block["tree"].iat[0],
                "place": [int(ordered["place"].iat[0]) // FANOUT**levels],
                "n": nodes_after(n, levels),
                "digest": root,
            }
        )

    found = [nodes]
    while True:
        below = found[-1].select("tree", "place", "n", "digest", _block(levels))
        roots = below.groupBy("tree", "block").applyInPandas(reduce, "tree string, place long, n long, digest string")
        found.append(materialize(roots, "subtrees"))
        if (found[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return found


def _exchange(
    nodes: DataFrame, outer: DataFrame, finish: Callable, schema: str, levels: int
) -> DataFrame:
    """Nodes and the paths outside their superblock, cogrouped by superblock."""
    below = nodes.withColumn("block", _block(levels))
    above = outer.withColumnRenamed("place", "block")
    return (
        below.groupBy("tree", "block")
        .cogroup(above.groupBy("tree", "block"))
        .applyInPandas(lambda own, out: finish(own.sort_values("place"), out.iloc[0]), schema)
    )


def _descended(rounds: Sequence[DataFrame], outer: DataFrame, levels: int, down_to: int) -> DataFrame:
    """Paths from the nodes of round ``down_to`` to the root, given those of the last round."""

    def join_paths(own: pd.DataFrame, out: pd.Series) -> pd.DataFrame:
        inner = paths(own["digest"].tolist(), spanned(int(own["n"].iat[0]), levels))
        return pd.DataFrame(
            {
                "tree": own["tree"],
                "place": own["place"],
                "lefts": [[left for left, _ in path] + list(out["lefts"]) for path in inner],
                "rights": [[right for _, right in path] + list(out["rights"]) for path in inner],
                "subroot": out["subroot"],
                "root": out["root"],
            }
        )

    for nodes in reversed(rounds[down_to:-1]):
        outer = materialize(_exchange(nodes, outer, join_paths, _PATH, levels), "paths")
    return outer


# --- the manifest ----------------------------------------------------------------------


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows spell alike."""
    text = value.cast("string")
    said = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.when(value.isNull(), F.lit("-")).otherwise(said)


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def merkle_manifest(
    docs: DataFrame,
    claims: DataFrame | Column | None = None,
    fields: Sequence[str] = FIELDS,
    tree_col: str = "lang",
    id_col: str = "doc_id",
    levels: int = LEVELS,
    with_proof: bool = False,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``claims`` is the digest that a row is said to have, as a column over ``docs``
    (null: its own); ``verified`` tells whether it leads to the root with the row's
    siblings. ``with_proof`` adds the siblings as ``lefts`` and ``rights`` by level.
    """
    leaves = docs.select(
        F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string"))).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None) if claims is None else claims).cast("string").alias("claim"),
    )
    # hashed once: the range partitioner would read its input twice
    nodes = materialize(_numbered(materialize(leaves, "leaves"), ["id", "digest"]), "leaves")
    rounds = _rounds(nodes.select("tree", "place", "n", "digest"), levels)
    subroots = rounds[-1].select(F.lit(_TOP).alias("tree"), F.col("tree").alias("named"), "digest")
    tops = materialize(_numbered(subroots, ["named"]), "roots")
    top_rounds = _rounds(tops.select("tree", "place", "n", "digest"), levels)
    none = F.array().cast("array<string>")
    top = top_rounds[-1].select(
        "tree", "place", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("subroot"), F.col("digest").alias("root")
    )
    from_roots = _descended(top_rounds, top, levels, 0)
    outer = from_roots.drop("tree", "subroot").join(tops.select("place", "named", F.col("digest").alias("subroot")), "place")
    outer = outer.select(F.col("named").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "subroot", "root")
    outer = _descended(rounds, outer, levels, 1)

    def prove(own: pd.DataFrame, out: pd.Series) -> pd.DataFrame:
        tail = list(zip(out["lefts"], out["rights"]))
        outside = "".join(left + right for left, right in tail)
        leaf = own["digest"].tolist()
        proofs, roots, full = [], [], []
        for own_leaf, claim, inner in zip(leaf, own["claim"], paths(leaf, spanned(int(own["n"].iat[0]), levels))):
            proofs.append(digest("".join([left + right for left, right in inner]) + outside))
            roots.append(folded(claim or own_leaf, inner + tail))
            full.append(inner + tail if with_proof else None)
        return pd.DataFrame(
            {
                "doc_id": own["id"],
                "leaf": leaf,
                "subroot": out["subroot"],
                "root": out["root"],
                "proof_sha256": proofs,
                "folded_root": roots,
                "lefts": [p and [left for left, _ in p] for p in full],
                "rights": [p and [right for _, right in p] for p in full],
            }
        )

    # ids travel as text: pandas has no null among 64-bit numbers
    proven = _exchange(nodes.withColumn("id", F.col("id").cast("string")), outer, prove, _PROVEN, levels)
    found = proven.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    found = found.withColumn("verified", F.col("folded_root") == F.col("root"))
    return found if with_proof else found.drop("lefts", "rights")
