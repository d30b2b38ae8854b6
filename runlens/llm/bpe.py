"""Byte-level BPE by monoid tree reduction.

A match is halved until its halves are tokens or single bytes; two encoded
neighbours are joined by encoding a window around the border anew. The window
grows until its outer tokens come out unchanged. That is enough: a token sequence
is the encoding of its bytes exactly when each adjacent pair is the encoding of its
own bytes, and then every pair of the joined sequence has been seen inside a left
part, a right part or a window. Decoding concatenates up a balanced tree.

Windows grow by one token: a table has the encodings of token pairs. A pair that does
not stand is replaced by its encoding, and the pairs that this makes are looked at in
turn, until those on both sides stand. Equal parts of a long match are encoded once,
so a run of one character, whose windows reach its end, stays cheap.

Defined cases: a null or empty text has no ids and decodes to no bytes; rows that
repeat are encoded each; a very long run without white space is one match and takes
time nearly in proportion to its length; an empty table gives an empty table; other
columns of the input are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import Generations, PieceCache, in_slices, read_bytes, read_ranks

Ids = tuple[int, ...]
_NEVER = 1 << 40  # rank of a pair that is no token


class TreeCodec:
    """Encoder and decoder of one vocabulary; ``memo`` bounds the bytes of its tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 96 << 20):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.matches = regex.compile(pattern).findall
        self.borders = Generations(self._border, memo // 2, 260)  # encoding of two tokens' bytes
        self.parts = Generations(self._halved, memo // 2)

    def _border(self, pair: tuple[int, int]) -> Ids:
        return self.by_rank(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])

    # --- windows: merge the adjacent pair of lowest rank until none is left

    def by_rank(self, data: bytes) -> Ids:
        rank_of = self.ranks.get
        tokens = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(data[i : i + 2], _NEVER) for i in range(len(data) - 1)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            tokens[at] += tokens.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(tokens[at - 1] + tokens[at], _NEVER)
            if at < len(ranks):
                ranks[at] = rank_of(tokens[at] + tokens[at + 1], _NEVER)
        return tuple([self.ranks[t] for t in tokens])

    # --- the tree

    def join(self, left: Ids, right: Ids) -> Ids:
        """Encoding of the bytes of two encodings set side by side.

        ``out`` is settled up to its last token; ``window`` holds what follows it, and
        then the rest of ``right``. Each pair that does not stand is replaced by its encoding.
        """
        if not left or not right:
            return left or right
        borders = self.borders
        pair = left[-1], right[0]
        found = borders[pair]
        if found == pair:
            return left + right
        out, window, j = list(left[:-1]), list(found[::-1]), 1
        for _ in range(64 + 8 * (len(left) + len(right))):
            if window:
                token = window.pop()
                if not out:
                    out.append(token)
                    continue
                pair = out[-1], token
                found = borders[pair]
                if found == pair:
                    out.append(token)
                    continue
            elif j == len(right):
                return tuple(out)
            else:
                pair = out[-1], right[j]
                found = borders[pair]
                if found == pair:
                    return tuple(out) + right[j:]
                j += 1
            out.pop()
            window += found[::-1]
        return self.by_rank(b"".join([self.bytes_of[t] for t in left + right]))

    def _halved(self, data: bytes) -> Ids:
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        middle = len(data) // 2
        return self.join(self.parts[data[:middle]], self.parts[data[middle:]])

    def encode_match(self, data: bytes) -> Ids:
        rank = self.ranks.get(data)
        if rank is not None:
            return (rank,)
        if len(data) <= 32:
            middle = len(data) // 2
            return self.join(self.parts[data[:middle]], self.parts[data[middle:]]) if data else ()
        own: dict[bytes, Ids] = {}  # long parts of this match, equal ones once

        def halved(part: bytes) -> Ids:
            if len(part) <= 32:
                return self.parts[part]
            found = own.get(part)
            if found is None:
                middle = len(part) // 2
                found = own[part] = self.join(halved(part[:middle]), halved(part[middle:]))
            return found

        return halved(data)

    def encode(self, text: str) -> bytes:
        """Ids of every match, as little-endian unsigned 32-bit numbers."""
        encode = self.encode_match
        found = [encode(match.encode("utf-8", "surrogatepass")) for match in self.matches(text)]
        return array("I", chain.from_iterable(found)).tobytes()

    def encode_word(self, word: str) -> bytes:
        """``encode`` for a text that is one match."""
        return array("I", self.encode_match(word.encode())).tobytes()

    def decode(self, ids: Sequence[int]) -> bytes:
        level = [
            b"".join(map(self.bytes_of.__getitem__, ids[i : i + 512])) for i in range(0, len(ids), 512)
        ]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of every text; ``decoded`` is read back from the ids.

    The rank file is read on the driver and shipped as bytes: a vocabulary file is
    some hundred kilobytes, whatever the corpus.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_bytes(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(read_ranks(shipped.value), pattern)
        cache = PieceCache(codec.encode, 96 << 20, encode_word=codec.encode_word)
        for batch in in_slices(batches):
            encoded = [cache.text_ids(t) for t in batch.column(1).to_pylist()]
            offsets = array("i", [0])
            for ids in encoded:
                offsets.append(offsets[-1] + len(ids) // 4)
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(encoded))]),
            )
            decoded = pa.array([codec.decode(array("I", e)) for e in encoded], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, decoded], names=["doc_id", "ids", "decoded"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
