import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_exact_dedup import brute as exact
from test_minhash_dedup import brute as near

ENGLISH = "the cat and the dog went over the hill with a friend of the house number "
GERMAN = "der hund und die katze gingen über den berg mit einem freund des hauses nummer "


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def table(documents):
    texts = []
    for i in range(40):
        words = ENGLISH if i % 2 else GERMAN
        texts.append((i, " ".join(f"{w}{'' if k % 3 else 'abcdefghij'[(i * 7 + k) % 10]}" for k, w in enumerate(words.split() * 4)), "en" if i % 2 else "de"))
    texts += [(100 + i, texts[i][1].replace(" ", "  "), texts[i][2]) for i in range(6)]
    texts += [(200 + i, texts[i + 10][1] + " end", texts[i + 10][2]) for i in range(6)]
    texts += [(300, None, None), (301, "", "en"), (302, "12 !! 34", "en"), (303, ENGLISH + "password = abcdefgh12", "en")]
    return documents(texts)


def test_every_stage(spark, documents):
    docs = table(documents)
    found = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        found[name] = stage(spark, current, "")
        if name != "packing":
            assert found[name].columns == docs.columns
        current = found[name]
    letters = [(i, t) for i, t in rows_of(docs.na.fill("", ["text"])) if re.search("[a-z]", t)]
    assert rows_of(found["language_id"]) == letters
    kept = {r[0] for r in exact(letters) if r[3]}
    once = [(i, t) for i, t in letters if i in kept]
    assert rows_of(found["exact_dedup"]) == once
    kept = {r[0] for r in near(once, 5) if r[3]}
    apart = [(i, t) for i, t in once if i in kept]
    assert 0 < len(apart) < len(once) < len(letters)
    assert rows_of(found["minhash_dedup"]) == apart
    clean = [(i, t.replace("password = abcdefgh12", "[assign]")) for i, t in apart]
    assert rows_of(found["secret_scan"]) == clean
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in found["packing"].collect():
        ids.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((p for _, p in sorted(own)), []) for i, own in ids.items()} == {
        i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in clean
    }


def test_language_stage_leaves_out_unlearned_scripts(spark, documents):
    other = [(400, "今天天气很好我们去公园", None), (401, "сегодня хорошая погода", None), (402, ENGLISH + "сегодня", None)]
    docs = table(documents)
    whole = docs.unionByName(documents(other))
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    assert rows_of(stage(spark, whole, "")) == sorted(rows_of(stage(spark, docs, "")) + [other[2][:2]])


def test_run(spark, documents, tmp_path):
    table(documents).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_missing_ids(spark, documents):
    """An id with two texts is two documents; a repeated row and a copy without id go."""
    other = ENGLISH.replace("cat", "friend of the house and the number") + "on a hill and over the house again"
    rows = [(1, ENGLISH, "en"), (5, ENGLISH, "en"), (5, other, "en"), (7, GERMAN, "de"), (7, GERMAN, "de"), (None, GERMAN, "de")]
    docs = documents(rows)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, docs, "")
    assert rows_of(once) == [(1, ENGLISH), (5, other), (7, GERMAN)]
    assert rows_of(stages["minhash_dedup"](spark, docs, "")) == [(1, ENGLISH), (5, other), (7, GERMAN)]
