import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm.components import _joined, components
from runlens.llm.minhash_dedup import drop_near_duplicates, near_duplicates, shingle_sets
from runlens.llm.words import WordHasher


def shingles(text, size=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < size else set(zip(*[words[k:] for k in range(size)]))


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def brute(rows, size=2):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    edges = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if near(sets[i], sets[j])]
    found = union_find(ids, edges)
    return sorted((i, len(sets[i]), found[i], found[i] == i) for i, _ in rows)


def variants(seed=3, copies=60, words=120):
    """A text with many edited copies at every distance, a chain, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=words)
    texts = []
    for _ in range(copies):
        own = list(base)
        for place in rng.sample(range(words), rng.randint(0, 22)):
            own[place] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    chain = rng.choices(vocabulary, k=80)
    for _ in range(12):
        chain = chain[4:] + rng.choices(vocabulary, k=4)
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    rng.shuffle(texts)
    return texts


HARD = [None, "", " \t\n", "one", "One", "one two", "ONE\x0btwo", "one two three", "É a", "é a", "a a a a", "a a", " ", "x y " * 30_000]


def test_against_brute_force(documents, with_clashes):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(HARD + variants())] + [(2000, "one two"), (2000, "one two")]
    found = near_duplicates(with_clashes(documents(rows)), size=2, block=16)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_filter(documents):
    rows = [(i, t) for i, t in enumerate(HARD + variants(seed=5, copies=20))]
    docs = documents(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _, keep in brute(rows, 5) if keep]


def test_empty(documents):
    assert near_duplicates(documents([])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAB é\t\n\x0c ", max_size=30), max_size=8), st.integers(1, 40))
def test_sets_of_blocks(texts, block):
    found = {}
    for first, sets in shingle_sets(pa.array(texts, pa.string()), WordHasher(lower=True, block=block), 2):
        found |= {first + k: s for k, s in enumerate(sets)}
    assert [len(found[i]) for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(found[i], found[j])) == len(shingles(a) & shingles(b))


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    edges += [(200, i) for i in range(150, 199)]
    df = spark.createDataFrame(edges, "u long, v long")
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {n: c for n, c in union_find({n for e in edges for n in e}, edges).items() if n in nodes}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_edges_of_a_task_become_stars(edges):
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    nodes = {n for e in edges for n in e}
    moved, root = _joined(u, v)
    assert dict(zip(moved.tolist(), root.tolist())) == {n: c for n, c in union_find(nodes, edges).items() if n != c}


def test_a_path_is_joined_in_few_steps():
    path = np.random.default_rng(5).permutation(1 << 18).astype(np.int64)
    moved, root = _joined(path[:-1], path[1:])
    assert len(moved) == len(path) - 1 and not root.any()


def test_components_when_no_task_has_two_edges(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (41, 30), (41, 42), (50, 51)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(100, "u", "v")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == union_find({n for e in edges for n in e}, edges)


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert components(spark.range(1).select(F.lit(5).alias("u").cast("long"), F.lit(5).alias("v").cast("long"))).count() == 0


def thue_morse(n):
    """Two words of ``n`` letters whose polynomial hashes modulo 2^64 agree for every base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 17, 64, 1024, 4096])
def test_long_structured_words(documents, n):
    a, b = thue_morse(n)
    rows = [(i, " ".join([w, *"pq"[: i % 2], w])) for i, w in enumerate([a, b, a, b])] + [(9, f"{a} {a}")]
    found = near_duplicates(documents(rows), size=2)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert {r.component_id for r in found.collect()} >= {0, 1}


def test_ids_with_several_texts(documents):
    text = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, text), (5, text + " end"), (5, other), (7, "x y z"), (7, "x y z"), (None, text + " more"), (None, "alone here"), (8, ""), (8, ""), (9, None)]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(rows), size=2).collect()), key=str)
    assert found == sorted(
        [(1, 199, 1, True), (5, 200, 1, False), (5, 49, 5, True), (7, 2, 7, True), (7, 2, 7, True), (None, 200, 1, False),
         (None, 1, None, True), (8, 0, 8, True), (8, 0, 8, True), (9, 0, 9, True)], key=str,
    )
    left = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(documents(rows)).collect()), key=str)
    assert left == sorted([(1, text), (5, other), (7, "x y z"), (None, "alone here"), (8, ""), (9, None)], key=str)
