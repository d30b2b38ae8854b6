from pyspark.sql import functions as F

import hashlib
import re

from runlens.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (7, " "), (8, "a b "), (6, "\u00a0"),
    (1, "x" * 200_000), (10, "x" * 200_000), (11, "A b"), (11, "A b"),
]


def brute(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        out.append((i, min(g), len(g), i == min(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(documents, with_clashes):
    found = exact_duplicates(with_clashes(documents(ROWS)))
    assert sorted(tuple(r) for r in found.collect()) == brute(ROWS)


def test_filter_keeps_columns(documents):
    docs = documents(ROWS)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 8, 11]


def test_empty(documents):
    assert exact_duplicates(documents([])).collect() == []


def test_null_id(documents):
    found = exact_duplicates(documents([(None, "a"), (1, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id is None, r.keep_id or 0, r.kept) for r in found) == [
        (False, 1, True), (True, 0, True), (True, 1, False),
    ]


def test_plan_is_native(documents):
    plan = exact_duplicates(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "SortAggregate"))


def test_filter_tells_rows_apart_by_text(documents, with_clashes):
    rows = [(1, "dup"), (5, "dup"), (5, "unique text"), (7, "x"), (7, "x"), (None, "x"), (None, "y"), (None, "y"), (3, None), (2, ""), (9, " a \t b"), (8, " a  b")]
    docs = with_clashes(documents(rows)).withColumn("odd name", F.lit(1)).withColumn("order", F.create_map(F.lit(1), F.lit(2)))
    kept = drop_exact_duplicates(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(1, "dup"), (5, "unique text"), (7, "x"), (None, "y"), (2, ""), (8, " a  b")], key=str)
