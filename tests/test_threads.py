import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.context import conversation_context
from runlens.operators.threads import render_threads, store_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(seed, hot=130):
    rng = random.Random(seed)
    rows = [(1, t, "user", None if t % 17 == 3 else f"hot {t}") for t in range(hot)]
    rows += [(c, t * 2, "bot", f"{c}/{t}") for c in range(2, 12) for t in range(rng.randint(1, 25))]
    rows += [(None, t, "user", f"none {t}") for t in range(9)] + [(50, 0, "user", None)]
    rng.shuffle(rows)
    return rows


def plain(rows, depth=None):
    found = {}
    by_conversation = {}
    for r in rows:
        by_conversation.setdefault(r[0], []).append(r)
    for c, own in by_conversation.items():
        own.sort(key=lambda r: r[1])
        for i, r in enumerate(own):
            near = depth or len(own)
            before, after = own[max(0, i - near) : i], own[i + 1 : i + 1 + near]
            thread = [x[3] for x in before if x[3] is not None]
            replies = [x[3] for x in after if x[3] is not None]
            found[c, r[1]] = (r[3], thread[-1] if thread else None, thread, replies, i - len(before), len(own) - i - 1 - len(after))
    return found


def rendered(df):
    return {
        (r.conv_id, r.turn): (r.text, r.parent, r.thread, r.replies, r.thread_left_out, r.replies_left_out) for r in df.collect()
    }


@pytest.mark.parametrize("depth", [None, 1, 3, 8, 20])
@pytest.mark.parametrize("size", [4, 7, 1000])
def test_against_plain_lists(spark, depth, size):
    rows = rows_of(1)
    store = store_turns(spark.createDataFrame(rows, SCHEMA).repartition(5), size=size)
    found = render_threads(store, depth)
    assert rendered(found) == plain(rows, depth)
    assert found.columns[:4] == ["conv_id", "turn", "role", "text"]


def test_texts_are_kept_once_in_bounded_blocks(spark, tmp_path):
    rows = rows_of(2)
    store = store_turns(spark.createDataFrame(rows, SCHEMA), size=8, path=str(tmp_path))
    assert "text" not in store.turns.columns
    sizes = [r.n for r in store.blocks.select(F.size("texts").alias("n")).collect()]
    assert max(sizes) == 8 and sum(sizes) == len(rows)
    assert (tmp_path / "blocks").exists()


def test_single_turns_are_rendered(spark):
    rows = rows_of(3)
    store = store_turns(spark.createDataFrame(rows, SCHEMA), size=8)
    found = rendered(render_threads(store, wanted=F.col("turn") == 6))
    assert found == {k: v for k, v in plain(rows).items() if k[1] == 6} and len(found) > 2


def test_a_conversation_with_most_rows_is_spread(spark):
    """A third of all rows in one conversation: many groups, and no window without bound."""
    turns = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, 0).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("t").alias("text")
    )
    whole = conversation_context(turns, depth=None)
    text = whole._jdf.queryExecution().toString()
    assert "Window" not in text and "SinglePartition" not in text
    store = store_turns(turns, size=64)
    hot = store.blocks.filter("conversation = 0")
    assert hot.count() == -(-10_000 // 64)
    tasks = hot.repartition(8, "conversation", "block").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 8
    one = render_threads(store, depth=5, wanted=F.col("conv_id") == 0)
    assert one.agg(F.sum(F.size("thread")), F.max("thread_left_out")).first() == (5 * 10_000 - 15, 9_994)


def test_empty(spark):
    assert conversation_context(spark.createDataFrame([], SCHEMA), depth=None).collect() == []
