"""Packing of token ids into windows: best-fit decreasing with a segment tree.

Every document is encoded, ended by a terminator, and cut into full windows first.
What remains is packed longest first: the tightest open window that still has room
is found in a segment tree indexed by remaining capacity. Gaps of ``min_gap`` tokens
or more that are left are filled by cutting the emptiest windows' pieces, and what
then stands in a single unfilled window leaves in sequences whose lengths are powers
of two, which need no padding.

The packing is done where the rows are read, so no text or id is shuffled; a task
holds one id array per document of its block. Sequence ids are the number of the
input partition and a running number: a lost task that runs again gives the same.

Defined cases: a null or empty text is its terminator alone; the file's added tokens
are found in a text and get their own ids, as the library does; rows that repeat are
packed each; a very long text gives full windows as they are cut; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import PieceCache, in_slices, read_added, read_bytes, read_vocabulary, with_added

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)
# A piece is (document, start, length); a window is a list of pieces.
Piece = tuple[int, int, int]
Window = list[Piece]


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _mark(self, capacity: int, value: int) -> None:
        node = self.leaves + capacity
        self.filled[node] = value
        while node > 1:
            node //= 2
            self.filled[node] = self.filled[2 * node] | self.filled[2 * node + 1]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            self._mark(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window with ``need`` tokens left."""
        node = self.leaves + need
        while not self.filled[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node //= 2
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity, 0)
        return capacity, window


def best_fit(pieces: list[Piece], capacity: int) -> list[Window]:
    tree, windows = CapacityTree(capacity), []
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        found = tree.take(piece[2])
        if found is None:
            room, at = capacity, len(windows)
            windows.append([])
        else:
            room, at = found
        windows[at].append(piece)
        if room > piece[2]:
            tree.add(room - piece[2], at)
    return windows


def fill_gaps(windows: list[Window], capacity: int, min_gap: int) -> list[Window]:
    """Fill gaps from the emptiest windows; split the last one into powers of two."""
    size = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: (-size[w], w))
    done = [windows[w] for w in order if capacity - size[w] < min_gap]
    open_ = [windows[w] for w in order if capacity - size[w] >= min_gap]
    size = [sum(p[2] for p in w) for w in open_]
    first, last = 0, len(open_) - 1
    while first < last:
        gap = capacity - size[first]
        if gap < min_gap:
            done.append(open_[first])
            first += 1
            continue
        doc, start, length = open_[last].pop()
        moved = min(gap, length)
        if moved < length:
            open_[last].append((doc, start, length - moved))
        open_[first].append((doc, start + length - moved, moved))
        size[first] += moved
        size[last] -= moved
        if not open_[last]:
            last -= 1
    if open_ and first == last:
        left = size[first]
        if capacity - left < min_gap:
            done.append(open_[first])
        else:
            queue = open_[first][::-1]
            for bit in range(left.bit_length() - 1, -1, -1):
                if not left >> bit & 1:
                    continue
                room, sequence = 1 << bit, []
                while room:
                    doc, start, length = queue.pop()
                    taken = min(room, length)
                    sequence.append((doc, start, taken))
                    if taken < length:
                        queue.append((doc, start + taken, length - taken))
                    room -= taken
                done.append(sequence)
    return done


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    capacity: int = 1024,
    terminator: int = 0,
    min_gap: int = 4,
    block: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece; ``ids`` are little-endian unsigned 32-bit numbers.

    A block of ``block`` documents is packed together, or a partition if it has
    fewer, which bounds what a task holds.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_bytes(vocabulary_path))
    end = np.uint32(terminator).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tiktoken.Encoding(
            "vocabulary", pat_str=pattern, mergeable_ranks=read_vocabulary(shipped.value), special_tokens={}
        )
        cache = PieceCache(lambda text: array("I", encoder.encode_ordinary(text)).tobytes())
        text_ids = with_added(cache.text_ids, read_added(shipped.value))
        next_id = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        tails: list[tuple[int, int, int, bytes]] = []  # id, document's tokens, start, ids

        def put(doc_id, tokens, start, ids, sequence, offset):
            rows.append((doc_id, start, len(ids) // 4, ids, tokens, sequence, offset))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            windows = best_fit([(i, 0, len(t[3]) // 4) for i, t in enumerate(tails)], capacity)
            for window in fill_gaps(windows, capacity, min_gap):
                offset = 0
                for i, start, length in window:
                    doc_id, tokens, at, ids = tails[i]
                    put(doc_id, tokens, at + start, ids[4 * start : 4 * (start + length)], next_id, offset)
                    offset += length
                next_id += 1
            tails.clear()
            yield from out()

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 4096):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            rows.clear()

        for batch in in_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = text_ids(text) + end
                tokens = len(ids) // 4
                full = tokens - tokens % capacity
                for start in range(0, full, capacity):
                    put(doc_id, tokens, start, ids[4 * start : 4 * (start + capacity)], next_id, 0)
                    next_id += 1
                if full < tokens:
                    tails.append((doc_id, tokens, full, ids[4 * full :]))
                if len(rows) >= 4096:
                    yield from out()
                if len(tails) >= block:
                    yield from flush()
        yield from flush()

    names = [field.split()[0] for field in SCHEMA.split(", ")]
    types = [pa.binary() if name == "ids" else pa.int64() for name in names]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, SCHEMA)
