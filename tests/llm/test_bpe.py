import random
import time

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlens.llm.bpe import TreeCodec, encode_texts
from runlens.llm.tokens import PieceCache, pieces, read_bytes, read_ranks, read_vocabulary

RANKS = read_ranks(read_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")))
CODEC = TreeCodec(RANKS, public_tokenizers.PATTERN)
CACHE = PieceCache(CODEC.encode, most=20_000)
LIBRARY = tiktoken.Encoding(
    "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
TEXTS = [
    "", " ", "  ", "a", "a  b", "it's we'll  \n\n x", "\n", "word\n next", "a \n b", "a\n \nb", "tab\t x", "x \t",
    "Zwölf Boxkämpfer", "中文字符 漢字", "👩‍👩‍👧 ok", "=" * 3000, "a" * 5000, "ab" * 4000, "é" * 999, "\x1c a", " \x1c",
    "a \u00a0b", "a\u2003 b", "1234 567", "<|endoftext|> x", "don't 've  '", "\u0301a e\u0301", "".join(map(chr, range(1, 700))),
]


def ids(data):
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def check(text):
    got = ids(CACHE.text_ids(text))
    assert got == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(got) == text.encode()


@pytest.mark.parametrize("text", TEXTS)
def test_cases(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorst '.\n", max_size=120))
def test_word_like(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=60))
def test_join_is_the_encoding(left, right):
    joined = CODEC.join(CODEC.encode_match(left), CODEC.encode_match(right))
    assert joined == CODEC.by_rank(left + right)


def test_every_token_encodes_to_itself():
    for token in random.Random(0).sample(sorted(RANKS), 3000):
        assert CODEC.by_rank(token) == (RANKS[token],)


def test_pieces_lose_nothing():
    for text in TEXTS:
        assert " ".join(pieces(text)) == text


def test_vocabulary_file_has_the_same_ranks():
    assert read_vocabulary(read_bytes(public_tokenizers.path("byte_bpe_50k.json"))) == RANKS


def test_library_of_the_vocabulary_file_agrees():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for text in TEXTS:
        assert library.encode(text, add_special_tokens=False).ids == ids(CACHE.text_ids(text))


def test_table(documents, with_clashes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (0, "again"), (0, "again")]
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = encode_texts(with_clashes(documents(rows)), *args).collect()
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in found)
    assert got == sorted((i, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert encode_texts(documents([]), *args).collect() == []


@pytest.mark.parametrize("part", ["=", "a", "7", "ab", "é", "abcdefghij", " "])
def test_a_million_equal_characters(part):
    text = part * (10**6 // len(part))
    start = time.perf_counter()
    found = CODEC.encode(text)
    assert time.perf_counter() - start < 10
    assert CODEC.decode(ids(found)) == text.encode()
    near = part * (20_001 // len(part))
    assert ids(CODEC.encode(near)) == LIBRARY.encode_ordinary(near)


def test_long_words_take_time_in_proportion():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (20_000, 200_000)]
    seconds = []
    for word in words:
        start = time.perf_counter()
        assert ids(CODEC.encode(word)) == LIBRARY.encode_ordinary(word)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 40 * max(seconds[0], 0.05)


def test_join_of_any_tokens():
    """Borders of random tokens, where windows grow most."""
    rng = random.Random(5)
    tokens = sorted(RANKS)
    for _ in range(20_000):
        left, right = (b"".join(rng.choices(tokens, k=rng.randint(1, 4))) for _ in range(2))
        assert CODEC.join(CODEC.by_rank(left), CODEC.by_rank(right)) == CODEC.by_rank(left + right)


def test_pieces_with_tails():
    for text in ("x don't, (we)'ll naïve-été ñandú... AÉ\u0301b aßb straße! a1b2 c_d e\u00adf x\u02b0y xʰ, Ωx aΩ a中b", "a\u0301b aªb aºb, a×b"):
        check(text)
