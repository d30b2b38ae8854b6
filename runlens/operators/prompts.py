"""Posts times definitions, and the prompts made of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

DEFINITIONS_AT_ONCE = 128
CALLOUT_NAME = "CALLOUT"


def build_tasks(posts: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per post and definition; every column of ``definitions`` is added.

    Definitions are read in groups of ``DEFINITIONS_AT_ONCE``; each group becomes an
    array literal exploded in place. Nothing is shuffled, there is no join, and any
    number of definitions works: a further group reads the posts once more.
    """
    groups = [posts.select("*", F.inline(_literals(rows, definitions))) for rows in _groups(definitions)]
    if not groups:
        return posts.limit(0).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in definitions.schema))
    return reduce(DataFrame.unionByName, groups)


def _groups(definitions: DataFrame) -> Iterator[Sequence[Row]]:
    return batched(definitions.toLocalIterator(), DEFINITIONS_AT_ONCE)


def _literals(rows: Sequence[Row], definitions: DataFrame) -> Column:
    return F.array(
        *(
            F.struct(*(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in definitions.schema))
            for row in rows
        )
    )


def fill(template: Column, **slots: Column) -> Column:
    """Put values into ``{slot}`` places; missing values become empty."""
    for name, value in slots.items():
        filled = F.coalesce(value.cast("string"), F.lit(""))
        template = F.replace(template, F.lit("{" + name + "}"), filled)
    return template


def render_prompts(tasks: DataFrame) -> DataFrame:
    """``prompt`` from the definition's template and the post's text."""
    return tasks.withColumn("prompt", fill(F.col("template"), text=F.col("text")))


def render_context_prompt(
    tasks: DataFrame, template: Column | str, short_text: str = "short_text"
) -> DataFrame:
    """``context_prompt`` from the caller's ``template``: a column, or the name of one.

    Slots are {definition}, {post_id} (Unknown if missing), {definition_text} (the
    definition's short text, or its name) and {text}.
    """
    named = F.concat(F.lit("Using the "), F.col("definition"), F.lit(" definition."))
    definition_text = F.coalesce(F.col(short_text), named) if short_text in tasks.columns else named
    prompt = fill(
        F.col(template) if isinstance(template, str) else template,
        definition=F.col("definition"),
        post_id=F.coalesce(F.col("post_id").cast("string"), F.lit("Unknown")),
        definition_text=definition_text,
        text=F.col("text"),  # last, so that braces in a post are never read as slots
    )
    return tasks.withColumn("context_prompt", prompt)


def with_callout(definitions: DataFrame, template: str, name: str = CALLOUT_NAME) -> DataFrame:
    """One more definition that asks whether a post calls the behaviour out."""
    row = definitions.sparkSession.range(1).select(
        F.lit(name).alias("definition"), F.lit(template).alias("template")
    )
    return definitions.unionByName(row, allowMissingColumns=True)
