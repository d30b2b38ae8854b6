"""Cleaning of post text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import NOT_SPACE, SPACE_RUN, WORD, unescape

_STEP = "_cleaning"


def clean_posts(
    df: DataFrame, text: str = "text", name: str = "text", entities: str = "all"
) -> DataFrame:
    """Decode entities, drop links and mentions, unmark hashtags, collapse whitespace.

    The order of the steps matters. A step with a marker only touches rows that hold
    it; each step is its own projection, so no expression is evaluated twice.
    """
    df = df.withColumn(_STEP, unescape(F.coalesce(F.col(text), F.lit("")), entities))
    for marker, pattern, kept in (
        ("://", rf"https?://{NOT_SPACE}+", ""),
        ("@", rf"@{WORD}+", ""),
        ("#", rf"#({WORD}+)", "$1"),
    ):
        step = F.col(_STEP)
        changed = F.when(F.contains(step, F.lit(marker)), F.regexp_replace(step, pattern, kept))
        df = df.withColumn(_STEP, changed.otherwise(step))
    cleaned = F.trim(F.regexp_replace(_STEP, SPACE_RUN, " "))
    return df.withColumn(name, cleaned).drop(_STEP)
