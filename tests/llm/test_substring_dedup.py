import random
import re

import numpy as np
import pytest

from runlens.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from runlens.llm import substring_dedup
from runlens.llm.substring_dedup import remove_repeated_windows, repeated_windows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size=13):
    first = {}
    for i, text in rows:
        words = split(text)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            first[window] = min(i, first.get(window, i))
    out = []
    for i, text in rows:
        words = split(text)
        gone = set()
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


def corpus(seed, docs=60):
    """Texts of few words with shared passages, at all offsets, near copies and copies."""
    rng = random.Random(seed)
    passages = [rng.choices("abcdefgh", k=n) for n in (12, 13, 14, 20, 60)]
    texts = []
    for _ in range(docs):
        words = rng.choices([*"abcdefghijklmnop", "é", "x y"], k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += [rng.choice(texts) for _ in range(10)] + ["z " * 500, "z " * 30, "z " * 12, None, "", " \t"]
    for _ in range(10):
        words = list(split(rng.choice(texts)))
        if words:
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot_docs", [2, 5_000])
def test_against_brute_force(documents, with_clashes, hot_docs):
    rows = corpus(hot_docs)
    found = remove_repeated_windows(with_clashes(documents(rows)), shard_runs=40, hot_docs=hot_docs)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_repeated_and_missing_ids(documents):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(4, passage), (4, passage), (4, "a " + passage), (7, "b " + passage), (None, passage + " c")]
    found = remove_repeated_windows(documents(rows)).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept[:1]) for r in found) == [
        (4, 20, 0, "w"), (4, 20, 0, "w"), (4, 21, 0, "a"), (7, 21, 20, "b"), (99, 21, 20, "c"),
    ]


def test_empty(documents):
    assert remove_repeated_windows(documents([])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_index(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, rng.integers(2, 40), rng.integers(1, 300))
    codes[-1] = 0
    assert suffix_array(codes).tolist() == sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    tree = WaveletMatrix(codes, int(codes.max()) + 1)
    symbols, places = rng.integers(0, codes.max() + 1, 50), rng.integers(0, len(codes) + 1, 50)
    assert tree.rank(symbols, places).tolist() == [(codes[:p] == s).sum() for s, p in zip(symbols, places)]
    index = FMIndex(codes)
    for length in (1, 2, 3, 5):
        starts = [i for i in range(len(codes) - length) if codes[i : i + length].min() > 0]
        patterns = np.array([codes[i : i + length] for i in starts], int).reshape(-1, length)
        if not len(patterns):
            continue
        low, high = index.search(patterns)
        for pattern, a, b in zip(patterns.tolist(), low, high):
            assert sorted(index.suffixes[a:b]) == [i for i in range(len(codes)) if codes[i : i + length].tolist() == pattern]


def test_repeated_windows_of_runs():
    runs = ["a b c d", "b c d e", "a b c", "x y z"]
    found = repeated_windows(runs, np.array([5, 3, 9, 1]), 3)
    assert [f.tolist() for f in found] == [[False, True], [False, False], [True], [False]]


@pytest.mark.parametrize("n", [16, 17, 1024, 4096])
def test_long_structured_words(documents, n):
    """Words whose polynomial hashes agree are different words."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    b = a.translate(str.maketrans("ab", "ba"))
    start = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {b} x"), (4, f"{a} {start}"), (5, f"{b} {start}")]
    found = remove_repeated_windows(documents(rows))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert [r[2] for r in sorted(found.select("doc_id", "n_words", "n_removed").collect())] == [0, 0, 13, 0, 0]


def test_windows_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(substring_dedup, "rolled", lambda words, size: np.zeros(len(words), np.uint64))
    runs = ["a b c d", "a b c", "b c d", "b c e"]
    found = repeated_windows(runs, np.array([4, 2, 3, 1]), 3)
    assert [f.tolist() for f in found] == [[True, True], [False], [False], [False]]


def test_smallest_in_ranges():
    rng = np.random.default_rng(2)
    values = np.append(rng.integers(0, 1000, 300), 10**9)
    low = rng.integers(0, 299, 500)
    high = np.minimum(low + rng.integers(1, 40, 500), 300)
    found = substring_dedup._smallest_in(values, low, high)
    assert found.tolist() == [values[a:b].min() for a, b in zip(low, high)]
