import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlens.llm.packing import CapacityTree, best_fit, fill_gaps, pack_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_tree_finds_the_tightest_window():
    rng, tree, model = random.Random(1), CapacityTree(64), {}
    for step in range(3000):
        if rng.random() < 0.5:
            capacity = rng.randint(1, 64)
            tree.add(capacity, step)
            model.setdefault(capacity, []).append(step)
        else:
            need = rng.randint(1, 64)
            fit = min((c for c in model if c >= need and model[c]), default=None)
            found = tree.take(need)
            assert found == (None if fit is None else (fit, model[fit].pop()))


@pytest.mark.parametrize("seed", range(30))
def test_blocks(seed):
    rng = random.Random(seed)
    pieces = [(i, 0, rng.randint(1, 1023)) for i in range(rng.choice([0, 1, 2, 40, 300]))]
    windows = fill_gaps(best_fit(pieces, 1024), 1024, 4)
    cover = {}
    for window in windows:
        size = sum(p[2] for p in window)
        assert 1021 <= size <= 1024 or size & (size - 1) == 0
        for doc, start, length in window:
            assert length > 0
            cover.setdefault(doc, []).append((start, length))
    assert len(cover) == len(pieces)
    for doc, _, total in pieces:
        at = 0
        for start, length in sorted(cover[doc]):
            assert start == at
            at += length
        assert at == total


def test_table(documents, with_clashes):
    texts = [None, "", "a", "word " * 3000, "word " * 1023, "word " * 1022 + "word", "é" * 5000, "\n\n x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "the cat sat. " * i) for i in range(60)]
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    packed = pack_documents(with_clashes(documents(rows)), VOCABULARY, public_tokenizers.PATTERN)
    got, sequences = {}, {}
    for r in packed.collect():
        part = np.frombuffer(r.ids, "<u4").tolist()
        assert len(part) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(part, "<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.start, part))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for _, part in sorted(p) for x in part] for i, p in got.items()} == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and (at >= 1021 or at & (at - 1) == 0)


def test_added_token_in_a_text(documents):
    end = "<|endoftext|>"
    texts = [end, f"{end}start", f"stop{end}", f"end of text {end} next", f" {end} ", f"a  {end}  b\n{end}\n", end * 3]
    texts += [f"<|{end}|>", "<|endoftext|", "<|ENDOFTEXT|>", f"it's {end}'s 12{end}34 é{end}é", f"word {end} " * 900]
    library = Tokenizer.from_file(VOCABULARY)
    got = {}
    for r in pack_documents(documents(list(enumerate(texts))), VOCABULARY, public_tokenizers.PATTERN).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, text in enumerate(texts):
        found = [x for _, part in sorted(got[i]) for x in part]
        assert found == [*library.encode(text, add_special_tokens=False).ids, 0]
        assert found.count(50256) == text.count(end)


def test_empty(documents):
    assert pack_documents(documents([]), VOCABULARY, public_tokenizers.PATTERN).collect() == []
