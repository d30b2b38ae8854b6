"""Exact duplicates: 128-bit content hash groups whose bytes are compared.

Two texts are equal when they are identical after every run of space, tab, line
feed, vertical tab, form feed and carriage return became one space.

Defined cases: a null text counts as empty; all empty texts form one group; a row
without id never becomes the kept one unless its group has no id at all; rows that
repeat an id and a text are counted each and share the decision; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs that the normalisation changes: a lone space stays as it is.
_CHANGED_RUNS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CHANGED_RUNS, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Groups are made by content hash *and* bytes, so two texts that share a hash
    are two groups; copies collapse inside each task before anything moves, and
    every distinct text moves once. Rows find their group by hash and digest,
    without text; a group that holds a third of all rows is split by the join.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    groups = (
        rows.groupBy(F.unhex(F.md5("text")).alias("hash"), "text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select(
        "doc_id", F.unhex(F.md5("text")).alias("hash"), F.sha2("text", 256).alias("text_sha256")
    )
    return members.join(groups, ["hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text: of its smallest id; all columns stay.

    Rows are told apart by their text, never by their id alone: an id with two texts is
    two documents, and of repeated rows, or of rows without id, one stays. Each text
    moves once, with its row; copies collapse inside each task before.
    """
    text, norm = F.col(text_col), normalised(F.col(text_col))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.unhex(F.md5(norm)).alias("hash"),
        norm.alias("norm"),
        # the text as it was, where the key does not tell
        F.struct(
            F.struct(*others).alias("others"), F.when(text != norm, text).alias("spelled"), text.isNull().alias("no_text")
        ).alias("row"),
        F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text).alias("spelling")).alias("order"),
    )
    kept = rows.groupBy("hash", "norm").agg(F.min_by("row", "order").alias("row"))
    spelled = F.when(~F.col("row.no_text"), F.coalesce("row.spelled", "norm")).alias(text_col)
    return kept.select(*[spelled if c == text_col else F.col(f"row.others.`{c}`") for c in docs.columns])
