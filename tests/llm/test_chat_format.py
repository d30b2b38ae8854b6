from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm.chat_format import PART, escape, format_chats, loss_text, read_turns, text_part, unescape

TEXTS = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<|end|>", "\\<|start|>\\", "<<SYS>> <s>", "a\nb", "", None, "[[INST]", "é中👩"]


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return format_chats(turns.withColumn("content", text_part(F.col("text"))))


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TEXTS)]
    rows += [(2, 0, None, "only"), (None, 0, "assistant", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    found = formatted(spark, rows).select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    got = {r.conv_id: (sorted((t.role, t.text) for t in r.turns), r.loss) for r in found.collect()}
    want = {}
    for c, _, role, text in rows:
        turns, loss = want.setdefault(c, ([], []))
        turns.append((role or "", text or ""))
        if role == "assistant":
            loss.append(text or "")
    assert got == {c: (sorted(t), "".join(x)) for c, (t, x) in want.items()}


def test_no_control_string_survives_inside_texts(spark):
    row = formatted(spark, [(1, 0, "user", "".join(t or "" for t in TEXTS))]).collect()[0]
    assert row.formatted.count("<|") == 3 and "</s>" not in row.formatted and "[INST]" not in row.formatted


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<>[]/s|INSTend_SY a", max_size=25), min_size=1, max_size=60))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~unescape(escape(F.col("t"))).eqNullSafe(F.col("t"))).count() == 0


def test_parts(spark):
    content = [("text", "see <s>", None, None), ("image", None, "img-1", 3), None, ("audio", None, "a.wav", None),
               ("document", None, "d.pdf", 2), ("odd", "x", None, None), ("text", None, None, None)]
    turns = spark.createDataFrame(
        [(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{PART}>"
    )
    row = format_chats(turns).collect()[0]
    assert "see <\\s><|image|><|audio|><|document|><|end|>" in row.formatted
    assert [tuple(a) for a in row.attachments] == [("image", "img-1", 768), ("audio", "a.wav", 25), ("document", "d.pdf", 1024)]
    assert [tuple(s) for s in row.loss_spans] == [(len(row.formatted) - len("<|end|>"), 0)]


def test_empty(spark):
    assert formatted(spark, []).collect() == []
