"""Turns of conversations: kept once, in blocks of bounded size, and put together where they are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.shape import with_positions
from runlens.sources.storage import materialize

BLOCK_TURNS = 256


@dataclass(frozen=True)
class TurnStore:
    """``turns`` are the rows without their text; ``blocks`` hold the texts.

    A turn refers to its text by ``block`` and ``place`` (from 0 in its conversation). A block has
    up to ``size`` consecutive turns of one conversation as ``texts`` (place, text).
    """

    turns: DataFrame
    blocks: DataFrame
    size: int
    conversation: str
    text: str
    columns: tuple[str, ...]


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def store_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    text: str = "text",
    size: int = BLOCK_TURNS,
    path: str | None = None,
) -> TurnStore:
    """Number the turns of each conversation and write them once, in blocks of ``size``.

    Places come from range partitions, so a conversation of any length is spread from the start;
    ties of ``turn`` keep their input order. Rows without conversation are one conversation.
    """
    placed = with_positions(turns, conversation, turn, name="_pos")
    slot = F.pmod(F.xxhash64(conversation), F.lit(1024)).alias("_slot")
    spans = (
        placed.groupBy(F.col(conversation).alias("_conv"), slot)
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("n_turns"))
        .drop("_slot")
    )
    numbered = (
        placed.join(spans, _same(conversation, "_conv"))
        .withColumn("place", F.col("_pos") - F.col("_first"))
        .withColumn("block", F.expr(f"place div {int(size)}"))
        .drop("_pos", "_first", "_conv")
    )
    written = materialize(numbered, "turns", f"{path.rstrip('/')}/numbered" if path else None)
    blocks = written.groupBy(F.col(conversation).alias("conversation"), "block").agg(
        F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("text")))).alias("texts")
    )
    return TurnStore(
        written.drop(text),
        materialize(blocks, "blocks", f"{path.rstrip('/')}/blocks" if path else None),
        size,
        conversation,
        text,
        tuple(turns.columns),
    )


def render_threads(store: TurnStore, depth: int | None = None, wanted: Column | None = None) -> DataFrame:
    """The rows with ``parent``, ``thread`` and ``replies``: the texts before and after each.

    ``depth`` bounds both lists; what lies beyond is counted in ``thread_left_out`` and
    ``replies_left_out``. ``wanted`` is a condition on the rows to render; only their blocks
    meet the others. Each block goes to the blocks in reach of it, is put together with them
    there, and only then meets its own turns, so a long conversation is as many groups
    as it has blocks, and lists as long as its output asks for are made per row.
    """
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    size = store.size
    rows = store.turns if wanted is None else store.turns.filter(wanted)
    last = F.expr(f"(n_turns - 1) div {size}")
    home = F.col("block")
    if depth is None:
        targets = F.sequence(F.lit(0).cast("long"), last)
    else:
        reach = -(-depth // size)
        targets = F.sequence(F.greatest(home - reach, F.lit(0)), F.least(home + reach, last))
    sent = store.blocks.select("conversation", F.explode(targets).alias("target"), "block", "texts")
    if wanted is not None:
        asked = rows.select(F.col(store.conversation).alias("_conv"), F.col("block").alias("_block")).distinct()
        sent = sent.join(asked, _same("conversation", "_conv") & (F.col("target") == F.col("_block")), "left_semi")
    around = sent.groupBy(F.col("conversation").alias("_conv"), F.col("target").alias("_target")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "texts"))), lambda b: b["texts"])).alias("_near")
    )
    near = F.col("_near")
    at = (F.col("place") - near[0]["place"]).cast("int")  # of the turn, among the texts that are near

    def texts(start: Column, length: Column) -> Column:
        found = F.filter(F.slice(near, start + 1, length), lambda x: x["text"].isNotNull())
        return F.transform(found, lambda x: x["text"])

    before, after = at, F.size(near) - at - 1
    if depth is not None:
        before, after = F.least(before, F.lit(depth)), F.least(after, F.lit(depth))
    own = near[at]["text"].alias(store.text)
    left_out = (
        (F.col("place") - before).cast("long").alias("thread_left_out"),
        (F.col("n_turns") - F.col("place") - 1 - after).cast("long").alias("replies_left_out"),
    )
    return (
        rows.join(around, _same(store.conversation, "_conv") & (F.col("block") == F.col("_target")))
        .select(
            *[own if c == store.text else F.col(c) for c in store.columns],
            texts(at - before, before).alias("thread"),
            texts(at + 1, after).alias("replies"),
            *left_out,
        )
        .withColumn("parent", F.try_element_at("thread", F.lit(-1)))
    )
