"""Near duplicates by MinHash: universal hash minima, bands, verification, components.

A document's set is its distinct shingles of ``size`` lower-cased words (a shorter
text has one, its whole sequence). Equal sets are one class from the start, so copies cost one row.
288 minima in 48 bands of 6 lose a pair of similarity 0.8 with a chance under 1e-6.

Links need not all be listed to find the components. In each bucket every class is
checked against the bucket's smallest one; the links found give preliminary
components. Buckets tied together by candidates form families; in a family that
still has several components, all classes outside its largest component are compared
with all of the family, in blocks of bounded size, by exact intersection counts. So no
link between two components is missed that shares a bucket, and no pairs are listed
inside a component. All checks are on full sets.

Sets and buckets go by 64-bit hashes of words; a pair that is linked by them is compared
once more by its words.

Defined cases: a text without words, or null, has an empty set and is linked with
nothing; very long texts are sets like others, hashed in blocks; rows that repeat an id
are judged each by their own text; rows without id come after all others; ties go to the
smallest id; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import components, slot
from runlens.llm.words import U, WordHasher, mixed
from runlens.sources.storage import materialize

BANDS, ROWS = 48, 6
SHINGLE = 5
PERCENT = 80
BLOCK = 256
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_sets(texts: pa.Array, hasher: WordHasher, size: int = SHINGLE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of ``(first text, sorted distinct shingle hashes of each text)``."""
    for first, words, bounds in hasher.blocks(texts):
        rolled = words.copy()
        for k in range(1, size):
            rolled[: len(words) - k] = rolled[: len(words) - k] * U(0x9E3779B97F4A7C15) + words[k:]
        rolled = mixed(rolled)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                sets.append(np.unique(rolled[a : b - size + 1]))
            else:  # fewer words than a shingle: their sequence is the only one
                short = U(b - a)
                for w in words[a:b]:
                    short = mixed(np.array([short]) * U(31) + w)[0]
                sets.append(np.array([short], np.uint64)[: b - a])
        yield first, sets


class Signer:
    """Band hashes of shingle sets from the minima of multiply-shift hash functions."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        draw = np.random.default_rng(8128).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
        self.factors, self.terms = draw[0] * U(2) + U(1), draw[1]
        self.bands, self.rows = bands, rows
        self.weights = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | U(1)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima per set; sets must not be empty."""
        values = np.concatenate(sets)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.factors)), np.uint64)
        for k in range(len(self.factors)):
            out[:, k] = np.minimum.reduceat((values * self.factors[k] + self.terms[k]) >> U(32), starts)
        return out

    def band_hashes(self, sets: list[np.ndarray]) -> np.ndarray:
        found = self.minima(sets) * self.weights
        summed = found.reshape(len(sets), self.bands, self.rows).sum(axis=2, dtype=np.uint64)
        return mixed(summed + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def word_shingles(text: str, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The set of a text by its words themselves."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())  # of bytes, only A-Z change
    return {tuple(words)} if 0 < len(words) < size else set(zip(*[words[k:] for k in range(size)]))


def _signed(rows: DataFrame, size: int) -> DataFrame:
    """``doc_id, digest, n_shingles, set_key, bands`` of every row; key and bands null for empty sets."""
    schema = "doc_id long, digest binary, n_shingles long, set_key binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = WordHasher(lower=True), Signer()
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), hasher, size):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for i in full:
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                sizes = np.zeros(len(sets) + 1, np.int32)
                sizes[np.array(full, int) + 1] = signer.bands
                bands = signer.band_hashes([sets[i] for i in full]).ravel() if full else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        batch.column(1).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(bands)),
                    ],
                    names=["doc_id", "digest", "n_shingles", "set_key", "bands"],
                )

    return rows.mapInArrow(run, schema)


def _similar(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return _similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent)


def linked_by_words(left: str, right: str, percent: int, size: int) -> bool:
    a, b = word_shingles(left, size), word_shingles(right, size)
    return bool(a and b) and _similar(len(a), len(b), len(a & b), percent)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets are similar enough."""
    with_texts = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u").join(
        texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            left = [s for _, sets in shingle_sets(batch.column(2), hasher, size) for s in sets]
            right = [s for _, sets in shingle_sets(batch.column(3), hasher, size) for s in sets]
            found = [
                _linked(a, b, percent) and linked_by_words(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), percent, size)
                for i, (a, b) in enumerate(zip(left, right))
            ]
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return with_texts.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def _block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int, size: int) -> pd.DataFrame:
    """One link per pair of components among the classes of two blocks.

    Shared shingles are counted by a product of 0/1 matrices, columns in slices.
    """
    sides = []
    for side in (left, right):
        texts = pa.array(side["text"], pa.large_string())
        sides.append([s for _, sets in shingle_sets(texts, WordHasher(lower=True), size) for s in sets])
    sizes = [np.array([len(s) for s in sets]) for sets in sides]
    values, inverse = np.unique(np.concatenate([*sides[0], *sides[1]]), return_inverse=True)
    rows = np.repeat(np.arange(len(sides[0]) + len(sides[1])), np.concatenate(sizes))
    n = len(sides[0])
    # only shingles that both sides have can be shared
    both = np.zeros((2, len(values)), bool)
    both[0, inverse[rows < n]] = True
    both[1, inverse[rows >= n]] = True
    number = np.cumsum(both.all(axis=0)) - 1
    kept = both.all(axis=0)[inverse]
    rows, columns = rows[kept], number[inverse[kept]]
    common = np.zeros((n, len(sides[1])), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 16_384):
        own = (columns >= start) & (columns < start + 16_384)
        ones = np.zeros((n + len(sides[1]), min(16_384, int(number[-1]) + 1 - start)), np.float32)
        ones[rows[own], columns[own] - start] = 1
        common += ones[:n] @ ones[n:].T
    common = np.rint(common).astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    of_left, of_right = left["component"].to_numpy(), right["component"].to_numpy()
    i, j = np.nonzero((100 * common >= percent * union) & (of_left[:, None] != of_right[None, :]))
    # one link per pair of components: the first that holds by its words too
    _, pair = np.unique(np.stack([of_left[i], of_right[j]]), axis=1, return_inverse=True)
    pair = pair.reshape(-1)
    found = []
    while len(pair):
        _, firsts = np.unique(pair, return_index=True)
        done = np.zeros(int(pair.max()) + 1, bool)
        for k in firsts.tolist():
            if linked_by_words(left["text"].iat[i[k]], right["text"].iat[j[k]], percent, size):
                found.append((left["doc_id"].iat[i[k]], right["doc_id"].iat[j[k]]))
                done[pair[k]] = True
        rest = ~done[pair]
        rest[firsts] = False
        i, j, pair = i[rest], j[rest], pair[rest]
    return pd.DataFrame(found, columns=["u", "v"]).astype("int64")


def _cross_links(
    families: DataFrame, linked: DataFrame, texts: DataFrame, percent: int, size: int, block: int
) -> DataFrame:
    """Links between the preliminary components (``linked``) of each family (``node, family``)."""
    members = families.join(linked.select("node", F.col("component").alias("found")), "node", "left").select("node", "family", F.coalesce("found", "node").alias("component"))
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = (
        sizes.groupBy("family")
        .agg(
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("n", (-F.col("component")).alias("negated"))).alias("largest"),
        )
        .filter("parts > 1")
        .select(
            "family",
            (-F.col("largest.negated")).alias("main"),
            F.ceil(F.col("n") / block).alias("blocks"),
            F.ceil((F.col("n") - F.col("largest.n")) / block).alias("outer_blocks"),
        )
    )
    located = materialize(
        members.join(open_, "family").select(
            F.col("node").alias("doc_id"),
            "family",
            "component",
            "blocks",
            "outer_blocks",
            (F.col("component") != F.col("main")).alias("outer"),
            F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("long").alias("block"),
            F.pmod(F.xxhash64("node", F.lit(2)), "outer_blocks").cast("long").alias("outer_block"),
        ),
        "families",
    )
    with_text = located.join(texts, "doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = with_text.select("family", "block", every("outer_blocks").alias("outer_block"), "doc_id", "component", "text")
    outer = with_text.filter("outer").select(
        "family", every("blocks").alias("block"), "outer_block", "doc_id", "component", "text"
    )
    outer = outer.select(*[F.col(c).alias(f"outer_{c}") for c in outer.columns])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        return _block_links(left, right.set_axis(left.columns, axis=1), percent, size)

    keys = ["family", "block", "outer_block"]
    return (
        all_.groupBy(*keys)
        .cogroup(outer.groupBy("outer_family", "outer_block", "outer_outer_block"))
        .applyInPandas(compare, "u long, v long")
    )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")
    )


def _linked_classes(rows: DataFrame, size: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows, and classes of equal sets as ``node, doc_id, digest, set_key, component``.

    A class is known by its first row, of the smallest id; nodes are numbered in that
    order, so the smallest node of a component is its first document's. ``component`` is that node.
    """
    signed = materialize(_signed(rows, size), "signatures")
    full = signed.filter("set_key IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("first")
    order = ["missing", "doc_id", "set_key"]
    classes = materialize(
        full.groupBy("set_key", slot("set_key"))
        .agg(first)
        .select("set_key", "first.*")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.monotonically_increasing_id().alias("node"), "doc_id", "digest", "set_key"),
        "classes",
    )
    named = classes.select(*[F.col(c).alias(f"class_{c}") for c in classes.columns])
    same_row = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("digest") == F.col("class_digest"))
    bucketed = full.join(named, (F.col("set_key") == F.col("class_set_key")) & same_row).select(
        F.col("class_node").alias("doc_id"), F.explode("bands").alias("bucket")
    )
    buckets = (
        bucketed.groupBy("bucket", slot("bucket"))
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select("bucket", "least")
    )
    stars = materialize(
        bucketed.join(buckets, "bucket")
        .filter("doc_id <> least")
        .select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
        .distinct(),
        "candidates",
    )
    ends = stars.select(F.explode(F.array("u", "v")).alias("class_node"))
    wanted = named.join(ends, "class_node", "left_semi")
    texts = materialize(
        rows.join(wanted, same_row).groupBy(F.col("class_node").alias("doc_id")).agg(F.min("text").alias("text")), "texts"
    )
    links = materialize(_verified(stars, texts, percent, size), "links")
    families, linked = _families_and_linked(stars, links)
    crossed = materialize(_cross_links(families, linked, texts, percent, size, block), "links")
    found = linked if crossed.isEmpty() else _merged(linked, crossed)
    return signed, classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _families_and_linked(stars: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the candidates (``node, family``) and of the links (``node, component``).

    Both graphs go through the rounds together, the second with odd numbers for its nodes.
    """
    doubled = [F.shiftleft(c, 1).alias(c) for c in ("u", "v")]
    odd = [(F.shiftleft(c, 1) + 1).alias(c) for c in ("u", "v")]
    found = materialize(components(stars.select(*doubled).unionByName(links.select(*odd))), "components")
    node, component = F.shiftright("node", 1).alias("node"), F.shiftright("component", 1)
    families = found.filter(F.col("node") % 2 == 0).select(node, component.alias("family"))
    return families, found.filter(F.col("node") % 2 == 1).select(node, component.alias("component"))


def _merged(linked: DataFrame, crossed: DataFrame) -> DataFrame:
    """Components after more links: only the components' own nodes are linked anew."""
    root = linked.select("node", F.col("component").alias("root"))
    of = lambda end: root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    edges = crossed.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")
    )
    tops = components(edges).select(F.col("node").alias("root"), F.col("component").alias("top"))
    moved = root.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("component"))
    # nodes that only these links reach are their own root
    alone = tops.withColumnRenamed("root", "node").join(linked.select("node"), "node", "left_anti").select("node", F.col("top").alias("component"))
    return moved.unionByName(alone)


def near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    signed, classes = _linked_classes(_rows(docs, id_col, text_col), size, percent, block)
    named = classes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    placed = classes.select("set_key", "component").join(named, "component").select("set_key", "component_id")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(placed, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            component.alias("component_id"),
            component.eqNullSafe(F.col("doc_id")).alias("kept"),
        )
    )


def drop_near_duplicates(
    docs: DataFrame,
    size: int = SHINGLE,
    percent: int = PERCENT,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest id; all columns stay.

    Rows are told apart by id and text, so an id with two texts is two documents, and a
    repeated row stays once. Every text without words stays.
    """
    signed, classes = _linked_classes(_rows(docs, id_col, text_col), size, percent, block)
    first = classes.filter("node = component").select("doc_id", "digest")
    wordless = signed.filter("set_key IS NULL").select("doc_id", "digest").distinct()
    keepers = first.unionByName(wordless).select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_digest"))
    own = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kept = docs.withColumn("_own_digest", own).join(
        keepers, F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_own_digest") == F.col("_digest")), "left_semi"
    )
    return kept.dropDuplicates([id_col, "_own_digest"]).select(*docs.columns)
