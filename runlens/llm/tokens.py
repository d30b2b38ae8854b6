"""Parts shared by the operators that cut texts into vocabulary ids."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

# A space before a character that is no white space always starts a new match of the
# pre-tokenizer's pattern, so texts may be cut there and the pieces encoded apart.
_UNSAFE_SPACE = re.compile(r" (?:\s|$)")
_SAFE_SPACE = re.compile(r" (?=\S)")
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def pieces(text: str) -> list[str]:
    """``text`` cut at safe spaces; every piece but the first has lost its space."""
    if _UNSAFE_SPACE.search(text):
        return _SAFE_SPACE.split(text)
    return text.split(" ")


class Generations(dict):
    """A bounded memo: what is asked for again outlives the rest.

    Entries are made by ``make`` and kept in a young and an old generation. When the young
    one holds half of ``most`` bytes (as estimated), it becomes the old one.
    """

    def __init__(self, make: Callable, most: int, overhead: int = 200):
        super().__init__()
        self.make, self.half, self.overhead = make, most // 2, overhead
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.held += len(key) + len(found) + self.overhead
        if self.held > self.half:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = found
        return found


class PieceCache(Generations):
    """Little-endian unsigned 32-bit ids by piece (with its space); bounded, per task.

    A match of letters ends where they end, and what follows is matched on its own. So
    a word with a comma is put together from both, and only words are encoded anew.
    """

    def __init__(
        self,
        encode: Callable[[str], bytes],
        most: int = 44 << 20,
        chars: int = 64,
        encode_word: Callable[[str], bytes] | None = None,
    ):
        super().__init__(self._encoded, most - most // 16)
        self.encode, self.chars, self.encode_word = encode, chars, encode_word or encode
        self.tails = Generations(encode, most // 16)

    def _encoded(self, piece: str) -> bytes:
        letters = _LATIN_WORD.match(piece)
        if letters is None:
            return self.encode(" " + piece)
        end = letters.end()
        if end == len(piece):
            return self.encode_word(" " + piece)
        if not piece[end].isascii():  # a letter beyond these may follow
            return self.encode(" " + piece)
        tail = piece[end:]
        return self[piece[:end]] + (self.tails[tail] if len(tail) <= self.chars else self.encode(tail))

    def __missing__(self, piece: str) -> bytes:
        return super().__missing__(piece) if len(piece) <= self.chars else self._encoded(piece)

    def text_ids(self, text: str) -> bytes:
        first, *rest = pieces(text)
        return b"".join([self.encode(first), *[self[p] for p in rest]])


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    lines = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(data: bytes) -> dict[bytes, int]:
    """Ordinary tokens of a tokenizer file in JSON, special ones left out."""
    found = json.loads(data)
    special = {t["content"] for t in found.get("added_tokens", ()) if t.get("special")}
    byte = _byte_letters()
    return {
        bytes(byte[c] for c in token): id_
        for token, id_ in found["model"]["vocab"].items()
        if token not in special
    }


def read_added(data: bytes) -> dict[str, int]:
    """Added tokens of a tokenizer file in JSON, which are found in a text before it is cut."""
    added = json.loads(data).get("added_tokens", ())
    for token in added:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} needs more than its plain text")
    return {t["content"]: t["id"] for t in added}


def with_added(text_ids: Callable[[str], bytes], added: dict[str, int]) -> Callable[[str], bytes]:
    """``text_ids`` for texts that may hold added tokens: what stands between them is encoded apart."""
    if not added:
        return text_ids
    ids = {token: id_.to_bytes(4, "little") for token, id_ in added.items()}
    longest_first = sorted(map(re.escape, added), key=len, reverse=True)
    split = re.compile(f"({'|'.join(longest_first)})").split

    def run(text: str) -> bytes:
        first, *rest = split(text)
        return text_ids(first) + b"".join([ids[t] + text_ids(x) for t, x in zip(rest[::2], rest[1::2])])

    return run


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
