import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from runlens.llm.merkle import FIELDS, folded, leaf_digest, merkle_manifest, nodes_after, paths, reduced, spanned


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    """The whole tree in one list per level; ``rows`` are (doc_id, source, lang, n_chars, text)."""

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def beside(levels, i):
        for nodes in levels[:-1]:
            a = i // 8 * 8
            yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])
            i //= 8

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    null_first = lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))
    built = {name: up([plain_leaf(r) for r in sorted(trees[name], key=null_first)]) for name in names}
    top = up([built[name][-1][0] for name in names])
    found = []
    for k, name in enumerate(names):
        for i, row in enumerate(sorted(trees[name], key=null_first)):
            path = [*beside(built[name], i), *beside(top, k)]
            claim = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                claim = plain_leaf((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4])))
            end = claim
            for left, right in path:
                end = h(left, end, right)
            root = top[-1][0]
            found.append((row[0], plain_leaf(row), built[name][-1][0], root, h(*[a + b for a, b in path]), end, end == root))
    return sorted(found, key=repr)


def manifest(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    tampered = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if f == "text" else F.col(f) for f in FIELDS]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(tampered))
    return docs, merkle_manifest(docs, claim, **more)


def as_rows(df):
    return sorted([tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()], key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_brute_force(spark, levels):
    # trees of 1, 8, 9, 70 and 521 leaves: full, short and single runs, one and several rounds
    rows, next_id = [], 1
    for lang, n in ((None, 1), ("de", 8), ("en", 521), ("zz", 9), ("é", 70)):
        for _ in range(n):
            rows.append((next_id * 3, None if next_id % 5 == 0 else "src", lang, next_id % 11, f"Text É{next_id}" * (next_id % 4)))
            next_id += 1
    _, found = manifest(spark, rows, levels=levels)
    assert as_rows(found) == plain_manifest(rows)
    assert 0 < found.filter("NOT verified").count() < len(rows)


def test_nulls_repeats_and_clashes(spark, with_clashes):
    rows = [(None, None, None, None, None), (None, "a", None, 1, "B"), (4, "s", "en", 2, None), (4, "s", "en", 2, "X"), (4, "s", "en", 2, "X"), (6, "", "", 0, "")]
    docs, found = manifest(spark, rows)
    assert as_rows(found) == plain_manifest(rows)
    clashing = with_clashes(docs).withColumn("place", F.lit(1)).withColumn("tree", F.lit("x"))
    assert {r.root for r in merkle_manifest(clashing).collect()} == {r.root for r in found.collect()}
    assert merkle_manifest(clashing).filter("NOT verified").count() == 0


def test_one_row_and_none(spark):
    docs, found = manifest(spark, [(1, "s", "en", 1, "abc")])
    row = found.first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")
    assert merkle_manifest(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = "Ab" * 2_000_000
    _, found = manifest(spark, [(1, "s", "en", len(text), text), (2, "s", "en", 0, "")])
    assert as_rows(found) == plain_manifest([(1, "s", "en", len(text), text), (2, "s", "en", 0, "")])


def test_fields_do_not_run_together(spark):
    _, found = manifest(spark, [(1, "a", "b", 1, "1:c"), (2, "a", "b", 1, "c")])
    assert found.select("leaf").distinct().count() == 2


def test_proof_leads_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "de", 1, f"t{i}") for i in range(100)]
    _, found = manifest(spark, rows, with_proof=True, levels=1)
    for r in found.collect():
        assert folded(r.leaf, list(zip(r.lefts, r.rights))) == r.root


def test_superblocks():
    assert [spanned(n, 2) for n in (1, 2, 8, 9, 64, 65, 513)] == [0, 1, 1, 2, 2, 2, 2]
    assert [nodes_after(n, 2) for n in (1, 2, 64, 65, 513)] == [1, 1, 1, 2, 9]
    leaves = [h(str(i)) for i in range(70)]
    root = reduced(leaves, 3)[-1]
    assert len(root) == 1
    assert {folded(leaf, path) for leaf, path in zip(leaves, paths(leaves, 3))} == set(root)


def test_no_task_holds_a_tree(spark):
    """One language with nearly all rows is cut into superblocks of bounded size."""
    rows = [(i, "s", "en" if i else "de", 1, "t") for i in range(2_000)]
    docs, found = manifest(spark, rows, levels=1)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "block" in text and "SinglePartition" not in text
    assert found.count() == len(rows)
