"""Substring dedup: FM-indexes per shard, backward search, intervals above a threshold.

A window is ``size`` consecutive words. A window of a document is removed when the
same words also start in a document with a smaller id. The corpus is not searched
against the whole corpus: each window has an anchor, the smallest hash among its
five-word shingles, so equal windows have equal anchors. Anchors that only one
document has can hold no repeat. Runs of windows around the other anchors are sent
to the shard of their anchor; equal runs collapse before they move. A shard indexes
the runs it gets and searches each of their windows backwards through the wavelet
tree; the smallest id in the range that is found decides.

An anchor that very many documents share sends single windows, spread by their own
words, so no shard grows with one passage. Every window is handled, whatever its anchor.

Defined cases: a null text has no words; texts shorter than a window lose nothing;
repeats inside one document stay; rows that repeat an id never remove each other, and
each row is cut by its own text; a row without id comes after all others; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import slot
from runlens.llm.fm_index import FMIndex
from runlens.llm.words import U, WordHasher, mixed
from runlens.sources.storage import materialize

SIZE = 13
SHINGLE = 5
SHARD_RUNS = 20_000  # runs a shard gets on average
HOT_DOCS = 5_000  # documents of an anchor from which its windows travel alone
_NO_ID = (1 << 63) - 1
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = "shard long, doc_id long, row_hash long, start long, windows long, content string"
_INTERVAL = "doc_id long, row_hash long, start long, end long"


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each place on; the last ``size - 1`` places are not meant."""
    out = words.copy()
    for k in range(1, size):
        out[: len(words) - k] = out[: len(words) - k] * U(0xD6E8FEB86659FD93) + words[k:]
    return mixed(out)


def anchors_of(words: np.ndarray, size: int) -> np.ndarray:
    """The anchor of the window from each place on."""
    shingles = rolled(words, SHINGLE)
    out = shingles.copy()
    for k in range(1, size - SHINGLE + 1):
        np.minimum(out[: len(words) - k], shingles[k:], out=out[: len(words) - k])
    return out.view(np.int64)


def _anchors(rows: DataFrame, size: int) -> DataFrame:
    """``anchor, doc_id``: the different anchors of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words, bounds in hasher.blocks(batch.column(1)):
                found = anchors_of(words, size)
                own = [
                    np.unique(found[a : b - size + 1]) if b - a >= size else found[:0]
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                doc_ids = np.repeat(ids[first : first + len(own)], [len(o) for o in own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(own)), pa.array(doc_ids)], names=["anchor", "doc_id"]
                )

    return rows.select("doc_id", "text").mapInArrow(run, "anchor long, doc_id long")


def _runs(rows: DataFrame, size: int, shards: int) -> DataFrame:
    """Runs of windows around shared anchors, for ``rows`` with their ``anchors`` and ``hot`` ones.

    Equal runs of a batch are sent once, with the smallest id; for the other
    documents it is already decided, and only the place of the run travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            hashes = batch.column(2).to_pylist()
            runs: dict[tuple[int, str], list] = {}  # smallest id, its rows
            out: list[tuple] = []

            def decided(key, row):
                out.append((row[0] % shards, *row, None))

            def add(key, doc_id, row_hash, start, windows):
                row = (doc_id, row_hash, start, windows)
                kept = runs.get(key)
                if kept is None:
                    runs[key] = [doc_id, row]
                elif doc_id == kept[0]:
                    kept.append(row)
                elif doc_id > kept[0]:
                    decided(key, row)
                else:
                    for other in kept[1:]:
                        decided(key, other)
                    runs[key] = [doc_id, row]

            for first, words, bounds in hasher.blocks(texts):
                found = anchors_of(words, size)
                for k in range(len(bounds) - 1):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    if b - a < size:
                        continue
                    i = first + k
                    own = found[a : b - size + 1]
                    shared = np.isin(own, np.array(batch.column(3)[i].values, np.int64))
                    if not shared.any():
                        continue
                    hot = np.isin(own, np.array(batch.column(4)[i].values, np.int64))
                    edges = np.flatnonzero((own[1:] != own[:-1]) | hot[1:] | hot[:-1]) + 1
                    starts = np.concatenate([[0], edges])
                    ends = np.concatenate([edges, [len(own)]])
                    spelled = _WORDS.findall(texts[i].as_py())
                    for s, e in zip(starts[shared[starts]].tolist(), ends[shared[starts]].tolist()):
                        content = " ".join(spelled[s : e + size - 1])
                        add((0 if hot[s] else int(own[s]), content), ids[i], hashes[i], s, e - s)
            for (anchor, content), kept in runs.items():
                # hot windows are spread by their words
                place = anchor or zlib.crc32(content.encode())
                out += [(place % shards, *row, content) for row in kept[1:]]
            for at in range(0, len(out), 20_000):
                columns = zip(*out[at : at + 20_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _RUN.split(", ")]
                )

    types = [pa.int64()] * 5 + [pa.string()]
    return rows.select("doc_id", "text", "row_hash", "anchors", "hot").mapInArrow(run, _RUN)


def _different(codes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that begin at ``starts``: one of each content, and which of them each window equals.

    Windows are put together by hash and then compared; one that differs from the
    first of its hash is kept apart.
    """
    _, firsts, same = np.unique(rolled(mixed(codes.astype(np.uint64)), size)[starts], return_index=True, return_inverse=True)
    differs = np.zeros(len(starts), bool)
    for k in range(size):
        differs |= codes[starts + k] != codes[starts[firsts[same]] + k]
    odd = np.flatnonzero(differs)
    same[odd] = len(firsts) + np.arange(len(odd))
    return np.concatenate([firsts, odd]), same


def _smallest_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest of ``values`` in each range; ranges are taken in order, since ``reduceat`` also reads between them."""
    found = values[low]
    several = np.flatnonzero(high - low > 1)
    several = several[np.argsort(low[several], kind="stable")]
    if len(several):
        ends = np.column_stack([low[several], high[several]]).ravel()
        found[several] = np.minimum.reduceat(values, ends)[::2]
    return found


def repeated_windows(runs: list[str], docs: np.ndarray, size: int) -> list[np.ndarray]:
    """For each run of words, of the document ``docs``: which windows a smaller document has too.

    All runs are indexed; every window is searched backwards, and the smallest
    document in its range of the suffix array is compared.
    """
    spelled = pc.split_pattern(pa.array(runs, pa.large_string()), " ")
    # numbers of the words themselves, so nothing here rests on a hash of a word
    codes = spelled.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    bounds = np.append(0, np.cumsum(pc.list_value_length(spelled).to_numpy()))
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(runs)), lengths + 1)
    joined = np.zeros(len(codes) + len(runs), np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(len(runs)), lengths)
    joined[place] = codes
    index = FMIndex(joined)
    smallest = np.append(docs[owner[index.suffixes]], _NO_ID)

    starts = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(bounds[:-1], bounds[1:])])
    firsts, same = _different(codes, starts, size)
    found = np.empty(len(firsts), np.int64)
    for at in range(0, len(firsts), 1 << 16):
        begin = starts[firsts[at : at + (1 << 16)]]
        # a window whose end stands in one place only is its own single occurrence
        low, high = index.search(codes[begin[:, None] + np.arange(size)], until_one=True)
        found[at : at + len(low)] = _smallest_in(smallest, low, high)
    counts = lengths - size + 1
    repeated = found[same] < np.repeat(docs, counts)
    return np.split(repeated, np.cumsum(counts)[:-1])


def _shard_intervals(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Word intervals to remove, from the runs of one shard."""
    decided = rows["content"].isna()
    whole = [rows[decided]]
    rows = rows[~decided].reset_index(drop=True)
    parts = []
    if len(rows):
        code, contents = pd.factorize(rows["content"])
        least = rows.groupby(code)["doc_id"].min().to_numpy()
        later = rows["doc_id"].to_numpy() > least[code]
        whole.append(rows[later])
        repeated = repeated_windows(contents.tolist(), least, size)
        places, begins, ends = [], [], []
        for i in np.flatnonzero(~later).tolist():
            own = repeated[code[i]]
            if own.any():
                edge = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                begins.append(np.flatnonzero(edge == 1))
                ends.append(np.flatnonzero(edge == -1))
                places.append(np.full(len(begins[-1]), i))
        if places:
            at = np.concatenate(places)
            start = rows["start"].to_numpy()[at]
            parts.append(
                pd.DataFrame(
                    {"doc_id": rows["doc_id"].to_numpy()[at], "row_hash": rows["row_hash"].to_numpy()[at],
                     "start": start + np.concatenate(begins), "end": start + np.concatenate(ends) + size - 1}
                )
            )
    done = pd.concat(whole)
    done = done.assign(end=done["start"] + done["windows"] + size - 1)[["doc_id", "row_hash", "start", "end"]]
    return pd.concat([done, *parts]).astype("int64")


def _cut(rows: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of rows with the intervals of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, row_hash, cuts in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)]):
                words = _WORDS.findall(text)
                n = len(words)
                own = [(c["start"], c["end"]) for c in cuts or () if c["row_hash"] == row_hash]
                if own:
                    keep, at = [], 0
                    for start, end in sorted(own):
                        keep += words[at:start]
                        at = max(at, end)
                    words = keep + words[at:]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows.select("doc_id", "text", "row_hash", "cuts").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string"
    )


def remove_repeated_windows(
    docs: DataFrame,
    size: int = SIZE,
    shard_runs: int = SHARD_RUNS,
    hot_docs: int = HOT_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row; ``kept`` is the text that is left."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    anchors = _anchors(rows, size)
    shared = (
        anchors.groupBy("anchor", slot("anchor"))
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter("docs > 1")
        .select("anchor", (F.col("docs") >= hot_docs).alias("is_hot"))
    )
    wanted = materialize(
        anchors.join(shared, "anchor")
        .groupBy("doc_id")
        .agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot")),
        "anchors",
    )
    total = wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0
    shards = max(1, -(-total // shard_runs))
    # one exchange of the texts by id serves both joins below
    with_anchors = rows.join(wanted.hint("merge"), "doc_id").withColumn("row_hash", F.xxhash64("text"))
    intervals = (
        _runs(with_anchors, size, shards)
        .groupBy("shard")
        .applyInPandas(lambda pdf: _shard_intervals(pdf, size), _INTERVAL)
    )
    cuts = intervals.groupBy("doc_id").agg(F.collect_list(F.struct("row_hash", "start", "end")).alias("cuts"))
    placed = rows.join(cuts.hint("merge"), "doc_id", "left").withColumn("row_hash", F.xxhash64("text"))
    return _cut(placed).withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
