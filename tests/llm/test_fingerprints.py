import hashlib
import random
from collections import Counter

import numpy as np

from runlens.llm.fingerprints import SAMPLES, fingerprint_documents

WORDS = ["".join(random.Random(i).choices("abcdefghij", k=2 + i % 11)) for i in range(300)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n)]
    return texts + [texts[0], texts[5], None, "", " \n", "é👩 " * 40, "one", "x " * 20_000]


def bag(text):
    return {w: n * min(len(w), 12) ** 2 for w, n in Counter((text or "").split()).items()}


def similarity(a, b):
    a, b = bag(a), bag(b)
    keys = set(a) | set(b)
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if keys else 1.0


def test_against_exact_similarity(documents, with_clashes):
    texts = corpus()
    rows = [(i * 5, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in fingerprint_documents(with_clashes(documents(rows))).collect()}
    assert len(found) == len(rows)
    gaps = []
    for i, text in enumerate(texts):
        following, own = texts[i - 1] or "", text or ""  # ids descend, after the first comes the last
        third = len(own) // 3
        edited = own[: len(own) - third] + following[:third]
        r = found[i * 5]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        gaps += [r.near_edited - similarity(own, edited), r.near_next - similarity(own, following)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.6 / SAMPLES**0.5
    same = {}
    for i, text in enumerate(texts):
        key = tuple((text or "").split()) and text or ""
        same.setdefault(key if (text or "").split() else "", set()).add(tuple(found[i * 5].fingerprint))
    assert all(len(s) == 1 for s in same.values())


def test_error_of_the_estimates(documents):
    rng = random.Random(3)

    def fresh():
        return "".join(rng.choices("abcdefghijklmnop", k=8))

    texts = [" ".join(fresh() for _ in range(90)) for _ in range(400)]
    ratios = []
    for r in fingerprint_documents(documents(list(enumerate(texts)))).collect():
        assert len(r.fingerprint) >= 64 and len(r.edited_fingerprint) >= 64
        own, following = texts[r.doc_id], texts[r.doc_id - 1]
        third = len(own) // 3
        exact = similarity(own, own[: len(own) - third] + following[:third])
        ratios.append((r.near_edited - exact) ** 2 / (exact * (1 - exact)))
    assert np.mean(ratios) < 1 / 52  # the mean is one by the number of draws


def test_repeated_and_missing_ids(documents):
    rows = [(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "delta epsilon"), (None, "zeta eta")]
    found = fingerprint_documents(documents(rows)).collect()
    assert sorted(r.doc_id or 0 for r in found) == [0, 1, 1, 2]
    assert len({tuple(r.fingerprint) for r in found if r.doc_id == 1}) == 1


def test_one_document_is_its_own_neighbour(documents):
    row = fingerprint_documents(documents([(7, "some words here")])).collect()[0]
    assert row.near_next == 1.0


def test_empty(documents):
    assert fingerprint_documents(documents([])).collect() == []


def test_plan_is_native(documents):
    plan = fingerprint_documents(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
