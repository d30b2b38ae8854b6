"""Hard negatives: for each anchor and positive, the best rows of other labels.

Scores are integer inner products. Anchors and rows meet in blocks, twice. The first
pass keeps each block's best rows of the anchor's label, which give the anchor's
positives. The second pass knows the positives' scores; a block keeps, per positive,
the first ``n_negatives`` rows of other labels whose score is in the positive's
window. What a block leaves out has so many better rows in its own block, so it can be in no
result. Kept pairs become keys of (anchor, descending score, positives first, id); a
secondary sort brings them in order, and an iterator opens a window at each positive
and emits the negatives that follow, without holding an anchor's pairs.

Defined cases: rows without id, label or vector, or with a null or non-finite
component, take no part; of rows that repeat an id the smallest (label, vector)
counts; vectors of different length are compared over the components that both have;
equal scores go to the smaller id; a positive with a negative score has an empty
window; a score beyond 64 bits is an error; an empty table, or one without anchors,
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ranking import top_n_per_group
from runlens.sources.storage import materialize

SCALE = 256
EVERY = 100
POSITIVES = NEGATIVES = 5
LEAST_PERCENT = 80
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 512  # at most in a block
FEW_ROWS, FEW_BLOCKS = 512, 32  # small tables are still cut, so that tasks share the work
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BIAS = 1 << 63
_KEY = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])


# --- keys ------------------------------------------------------------------------------


def packed(anchor: np.ndarray, score: np.ndarray, negative: bool, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is anchor, descending score, positives before negatives, id."""
    biased = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(_BIAS)
    keys = np.empty(len(ids), _KEY)
    keys["anchor"], keys["down"], keys["kind"], keys["id"] = biased(anchor), ~biased(score), negative, biased(ids)
    flat = keys.tobytes()
    return [flat[i : i + _KEY.itemsize] for i in range(0, len(flat), _KEY.itemsize)]


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    number = lambda a: int.from_bytes(key[a : a + 8], "big")
    return number(0) - _BIAS, _BIAS - 1 - number(8), key[16] == 1, number(17) - _BIAS


def mined(keys: Iterator[bytes], n_negatives: int, least_percent: int) -> Iterator[tuple]:
    """Negatives of each positive, from keys in order; holds only the open windows."""
    current, windows = None, []
    for key in keys:
        anchor, score, negative, id_ = unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if not negative:
            windows.append([id_, score, 0])
            continue
        # scores only fall, so a window that this row misses is over
        windows = [w for w in windows if w[2] < n_negatives and least_percent * w[1] <= 100 * score]
        for window in windows:
            window[2] += 1
            yield anchor, window[0], window[2], id_, window[1], score


# --- blocks ------------------------------------------------------------------------------


def _whole(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of each component, as exact doubles, missing components zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return out


def _scores(anchors: pa.Table, rows: pa.Table) -> np.ndarray:
    width = max(pc.max(pc.list_value_length(t["vector"])).as_py() for t in (anchors, rows))
    a, b = _whole(anchors["vector"], width), _whole(rows["vector"], width)
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(width, 1)
    if most < 1 << 53:  # every partial sum is a whole number that a double holds
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in v] for v in a], object) @ np.array([[int(x) for x in v] for v in b], object).T
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= _BIAS:
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def _first(scores: np.ndarray, taken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best taken entries of each line; columns are in the order of their ids."""
    line, column = np.nonzero(taken)
    if len(line) and taken.shape[1] > 4 * k:  # leave out what is below the k-th best before sorting
        low = np.iinfo(np.int64).min
        bound = np.partition(np.where(taken, scores, low), -k, axis=1)[:, -k]
        near = scores[line, column] >= bound[line]
        line, column = line[near], column[near]
    order = np.lexsort((column, -scores[line, column], line))
    line, column = line[order], column[order]
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    rank = np.arange(len(line)) - np.repeat(starts, np.diff(np.r_[starts, len(line)]))
    return line[rank < k], column[rank < k]


def _ids(table: pa.Table) -> np.ndarray:
    return table["vec_id"].to_numpy()


def _block_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    rows = rows.sort_by("vec_id")
    ids, scores = _ids(rows), _scores(anchors, rows)
    same = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()
    line, column = _first(scores, same & (_ids(anchors)[:, None] != ids), k)
    return pa.table({"anchor_id": _ids(anchors)[line], "score": scores[line, column], "positive_id": ids[column]})


def _block_keys(anchors: pa.Table, rows: pa.Table, k: int, least_percent: int) -> pa.Table:
    rows = rows.sort_by("vec_id")
    ids, scores = _ids(rows), _scores(anchors, rows)
    other = anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()
    limits = anchors["positive_scores"].to_pylist()
    kept = np.zeros(scores.shape, bool)
    for i in range(max(map(len, limits))):
        own = np.flatnonzero([len(x) > i for x in limits])
        limit = np.array([limits[j][i] for j in own], np.int64)[:, None]
        # the least whole score of the window; Python's numbers, since the product may pass 64 bits
        least = np.array([-(-least_percent * int(x) // 100) for x in limit.ravel()], np.int64)[:, None]
        inside = other[own] & (scores[own] <= limit) & (scores[own] >= least)
        line, column = _first(scores[own], inside, k)
        kept[own[line], column] = True
    line, column = np.nonzero(kept)
    return pa.table({"key": pa.array(packed(_ids(anchors)[line], scores[line, column], True, ids[column]), pa.binary())})


def _in_blocks(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], find, schema: str) -> DataFrame:
    """``find`` for each block of anchors and block of rows."""
    n_anchors, n_rows = blocks
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = anchors.withColumn("a", own(n_anchors, 1)).withColumn("r", every(n_rows))
    right = rows.withColumn("r", own(n_rows, 2)).withColumn("a", every(n_anchors))
    # both sides read one table; new names keep their columns apart in the cogroup
    names = right.columns
    right = right.select(*[F.col(c).alias(f"row_{c}") for c in names])

    def both(some: pa.Table, others: pa.Table) -> pa.Table:
        if some.num_rows and others.num_rows:
            return find(some, others.rename_columns(names))
        return pa.table({f.split()[0]: pa.array([], pa.binary() if "binary" in f else pa.int64()) for f in schema.split(", ")})

    return left.groupBy("a", "r").cogroup(right.groupBy("row_a", "row_r")).applyInArrow(both, schema)


# --- the operator --------------------------------------------------------------------------


def usable_rows(vectors: DataFrame, id_col: str, label: str | Column, embedding: str) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, one per id."""
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(embedding).isNotNull() & finite)
        .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).alias("vector"))
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector")).alias("kept"))
        .select("vec_id", "kept.*")
    )


def mine_hard_negatives(
    vectors: DataFrame,
    label: str | Column = "label",
    every: int = EVERY,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    id_col: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Blocks hold at most
    ``BLOCK_ROWS`` rows and ``BLOCK_ANCHORS`` anchors on average, so their number grows with both.
    """
    spark = vectors.sparkSession
    rows = materialize(usable_rows(vectors, id_col, label, embedding), "vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    few = min(-(-n_rows // FEW_ROWS), FEW_BLOCKS)
    blocks = max(1, -(-n_anchors // BLOCK_ANCHORS)), max(1, few, -(-n_rows // BLOCK_ROWS))

    near = _in_blocks(
        anchors, rows, blocks, lambda a, r: _block_positives(a, r, n_positives), "anchor_id long, score long, positive_id long"
    )
    positives = materialize(
        top_n_per_group(near, ["anchor_id"], [F.col("score").desc(), F.col("positive_id")], n_positives), "positives"
    )
    limits = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("score").alias("positive_scores"))
    asked = materialize(anchors.join(limits, "vec_id"), "anchors")

    opening = positives.select("anchor_id", "score", "positive_id").mapInArrow(_opening_keys, "key binary")
    closing = _in_blocks(asked, rows, blocks, lambda a, r: _block_keys(a, r, n_negatives, least_percent), "key binary")
    keys = materialize(opening.unionByName(closing), "pairs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        parts, lambda key: unpacked(key)[0] // every
    )
    found = ordered.mapPartitions(lambda pairs: mined((key for key, _ in pairs), n_negatives, least_percent))
    return spark.createDataFrame(found, _MINED, verifySchema=False)


def _opening_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, score, ids = [batch.column(k).to_numpy() for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(packed(anchor, score, False, ids), pa.binary())], names=["key"])
