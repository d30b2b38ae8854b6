"""Hand cases for text rules, prompts, answers, documents and chunks."""

import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import context, prompts, topics
from runlens.operators.cleaning import clean_posts
from runlens.sources.definitions import missing_definitions, read_definitions, save_definition


def apply(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["out"] for r in df.orderBy("i").select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def clean_in_python(text):
    """The rule as plain Python, for comparison."""
    if text is None:
        return ""
    text = re.sub(r"https?://\S+", "", html.unescape(text))
    text = re.sub(r"#(\w+)", r"\1", re.sub(r"@\w+", "", text))
    return re.sub(r"\s+", " ", text).strip()


CLEAN_CASES = [
    "&amp;lt; a &#39;b&#39; &eacute; &copy &nbsp;x", "see https://a.b/c?d=1", "@ünal says #täg", "a\tb\n\n c \r\n",
    None, "", "  ", "@ alone # alone ##two", "x y z\x1cw", "http:// https://x", "e-mail a@b.c", "日本 @語 #題",
]


def clean(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["text"] for r in clean_posts(df).orderBy("i").collect()]


def test_clean_text(spark):
    assert clean(spark, CLEAN_CASES) == [clean_in_python(t) for t in CLEAN_CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("a Z9_#@&;:/.htps<é\n\t ß٣²"), max_size=40), min_size=1, max_size=30))
def test_clean_text_like_python(spark, texts):
    assert clean(spark, texts) == [clean_in_python(t) for t in texts]


def test_outbound_links(spark):
    text = "http://a.b/c https://t.co/1 https://www.twitter.com/z HTTP://q http://a.b/c\nhttps://twitter.com/x x http://t.co?y"
    (got, none, empty) = apply(spark, [text, None, "no links"], tx.outbound_links)
    assert got == ["http://a.b/c", "https://www.twitter.com/z", "http://a.b/c"]
    assert none == [] and empty == []


DECISION_CASES = {
    "DECISION: Yes\nEXPLANATION: because ": ("Yes", "because"),
    "EXPLANATION: first\nDECISION: YES": ("Yes", "first\nDECISION: YES"),
    "DECISION: maybe\nEXPLANATION: x EXPLANATION: y": ("Unclear", "x"),
    "DECISION: unknown\nEXPLANATION: none": ("No", "none"),
    "DECISION: no DECISION: yes EXPLANATION: z": ("No", "z"),
    "no markers here": ("No", "no markers here"),
    "x" * 50 + "yes": ("Unclear", "x" * 50 + "yes"),
    "x" * 47 + "yes": ("Yes", "x" * 47 + "yes"),
    "decision: yes explanation: lower case": ("Yes", "decision: yes explanation: lower case"),
    "DECISION: EXPLANATION:": ("Unclear", ""),
    "": ("Unclear", ""),
    None: ("Error", "null response"),
}


def test_parse_decision(spark):
    def make(col):
        decision, explanation = tx.parse_decision(col)
        return F.struct(decision.alias("d"), explanation.alias("e"))

    got = apply(spark, list(DECISION_CASES), make)
    assert [tuple(r) for r in got] == list(DECISION_CASES.values())


def test_parse_context_decision(spark):
    answers = ["Decision: Yes.", "so: DECISION: NO", "decision is yes", None, "Decision: No, not Decision: Yes"]
    got = apply(spark, answers, lambda c: tx.parse_context_decision(c)[0])
    assert got == ["Yes", "No", "Unclear", "Error", "Yes"]


def test_tokens_like_python(spark):
    texts = ["The café, naïve_x 12 a I'm", "ÉÀ 日本語 x", "", "a-b cd"]
    want = [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]
    assert apply(spark, texts, tx.tokens) == want


def test_prompt_keeps_braces_of_the_post(spark):
    posts = spark.createDataFrame([(1, "say {text} and {definition} $1 \\1"), (None, None)], "post_id long, text string")
    definitions = spark.createDataFrame([("D", "Q: {text}!")], "definition string, template string")
    tasks = prompts.render_prompts(prompts.build_tasks(posts, definitions))
    got = [r["prompt"] for r in tasks.orderBy(F.col("post_id").desc()).collect()]
    assert got == ["Q: say {text} and {definition} $1 \\1!", "Q: !"]
    template = F.lit("Post ID: {post_id}, {definition_text}: {text}")
    shown = [r["context_prompt"] for r in prompts.render_context_prompt(tasks, template).collect()]
    assert any("say {text} and {definition}" in p for p in shown)
    assert any("Post ID: Unknown" in p for p in shown)


def test_tasks_need_no_join(spark):
    posts = spark.range(10).select(F.col("id").alias("post_id"))
    definitions = spark.createDataFrame([("A", "x"), ("B", "y")], "definition string, template string")
    tasks = prompts.build_tasks(posts, definitions)
    assert tasks.count() == 20
    text = tasks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
    assert prompts.build_tasks(posts, definitions.limit(0)).count() == 0


def test_definitions_on_disk(spark, tmp_path):
    (tmp_path / "ihra.txt").write_text("first line\nTweet: {text}\n")
    save_definition(spark, str(tmp_path), "JDA", "two\nlines {text}")
    got = {r["definition"]: r["template"] for r in read_definitions(spark, str(tmp_path)).collect()}
    assert got == {"ihra": "first line\nTweet: {text}\n", "JDA": "two\nlines {text}"}
    asked = spark.createDataFrame([("IHRA",), ("jda",), ("other",)], "definition string")
    assert [r[0] for r in missing_definitions(asked, read_definitions(spark, str(tmp_path))).collect()] == ["other"]


def test_context_document_sections(spark):
    df = spark.createDataFrame(
        [(1, "t", "u", "p", ["a", "b"], ["r"], [], None), (2, "t", "", None, [], None, None, ["http://l"])],
        "post_id int, text string, username string, parent string, thread array<string>, replies array<string>, quoted array<string>, articles array<string>",
    )
    docs = {r["post_id"]: r["document"] for r in context.context_document(df).collect()}
    assert docs[1] == (
        "Original Tweet: t\n\nAuthor: u\n\nReplying to: p\n\nPrevious Tweets in Thread:\n- a\n- b\n\nReplies:\n- r\n"
    )
    assert docs[2] == "Original Tweet: t\n\n\nReferenced Content:\n- http://l\n"


@pytest.mark.parametrize("length,chunks", [(0, 0), (1, 1), (1000, 1), (1001, 2), (1801, 3), (1800, 2), (25800, 32), (25801, 33), (60000, 75)])
def test_fixed_chunks(spark, length, chunks):
    text = "".join(chr(97 + i % 26) for i in range(length))
    docs = spark.createDataFrame([(1, text)], "post_id int, document string")
    got = [r["chunk"] for r in context.chunk_documents(docs).orderBy("chunk_no").collect()]
    assert len(got) == chunks
    assert all(len(c) <= 1000 for c in got)
    assert all(a[-200:] == b[:200] for a, b in zip(got, got[1:]) if len(a) == 1000)
    assert "".join(c if i == 0 else c[200:] for i, c in enumerate(got)) == text


@given(st.lists(st.text(alphabet="ab \n👩", max_size=300), max_size=6), st.integers(8, 40), st.integers(0, 2))
@settings(max_examples=15, deadline=None)
def test_separator_chunks(spark, texts, size, overlap):
    docs = spark.createDataFrame(list(enumerate(texts)), "post_id int, document string")
    found = {}
    for r in context.chunk_documents(docs, size=size, overlap=overlap, separator_aware=True).orderBy("chunk_no").collect():
        found.setdefault(r["post_id"], []).append(r["chunk"])
    for i, text in enumerate(texts):
        chunks = found.get(i, [])
        assert all(0 < len(c) <= size for c in chunks)
        assert "".join(c if n == 0 else c[overlap:] for n, c in enumerate(chunks)) == text
        assert all(b[:overlap] == a[len(a) - overlap :] for a, b in zip(chunks, chunks[1:]))


def test_separator_chunks_prefer_line_ends(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb\ncc dd ee ffff gggg"), (2, "abcdefghijkl"), (3, None)], "post_id int, document string")
    chunks = context.chunk_documents(docs, size=12, overlap=0, separator_aware=True)
    got = [(r["post_id"], r["chunk"]) for r in chunks.orderBy("post_id", "chunk_no").collect()]
    assert got == [(1, "aaaa bbbb\n"), (1, "cc dd ee "), (1, "ffff gggg"), (2, "abcdefghijkl")]
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_definitions_than_a_group(spark):
    posts = spark.range(3).select(F.col("id").alias("post_id"), F.lit("t").alias("text"))
    many = spark.range(300).select(F.format_string("D%03d", "id").alias("definition"), F.lit("{text}").alias("template"))
    tasks = prompts.build_tasks(posts, many)
    assert tasks.count() == 900 and tasks.select("definition").distinct().count() == 300
    assert "Join" not in tasks._jdf.queryExecution().executedPlan().toString()


def test_full_threads(spark):
    df = spark.createDataFrame([(1, t, f"a{t}") for t in range(60)] + [(None, 1, "x")], "conv_id int, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r for r in context.conversation_context(df, depth=None).collect()}
    assert got[1, 50]["thread"] == [f"a{t}" for t in range(50)] and len(got[1, 50]["replies"]) == 9
    assert got[None, 1]["thread"] == []


def test_conversation_blocks_do_not_show(spark):
    # one conversation holds most turns and crosses many blocks
    rows = [(1, t, f"a{t}") for t in range(95)] + [(2, t, f"b{t}") for t in range(3)] + [(0, 7, "only")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r for r in context.conversation_context(df, depth=4, block=10).collect()}
    assert len(got) == len(rows)
    for (conv, turn), r in got.items():
        mine = [x[2] for x in sorted(rows) if x[0] == conv]
        at = mine.index(r["text"])
        assert r["thread"] == mine[max(0, at - 4) : at]
        assert r["replies"] == mine[at + 1 : at + 5]
        assert r["parent"] == (mine[at - 1] if at else None)
        assert r["thread_left_out"] == max(0, at - 4)
        assert r["replies_left_out"] == max(0, len(mine) - at - 5)


def test_stop_words_are_ours_to_choose(spark):
    df = spark.createDataFrame([("The cat and a dog",)], "text string")
    assert topics.tokenize(df).collect()[0]["tokens"] == ["cat", "dog"]
    assert topics.tokenize(df, stop_words=["cat"]).collect()[0]["tokens"] == ["the", "and", "dog"]
    assert topics.tokenize(df, stop_words=[]).collect()[0]["tokens"] == ["the", "cat", "and", "dog"]
