"""Text rules as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes that agree with Python's Unicode \w and \s. Java's (?U)\w also
# takes combining marks and its \s misses the separators 1C to 1F.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"
# runs to collapse: everything but a lone blank, which most whitespace is
SPACE_RUN = rf"{SPACE}{{2,}}|[\t-\r\x1c-\x1f\x85\p{{Z}}&&[^ ]]"

# Entities decoded by the native form. The ampersand goes last.
BASIC_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)

# Link hosts that carry no outside content.
EXCLUDED_HOSTS = ("twitter.com", "t.co")

# Markers and decision names of a model answer.
DECISION_MARK = "DECISION:"
EXPLANATION_MARK = "EXPLANATION:"
YES, NO, UNCLEAR, ERROR = "Yes", "No", "Unclear", "Error"
UNMARKED_PREFIX = 50


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A{SPACE}+|{SPACE}+\z", "")


def text_length(col: Column) -> Column:
    return F.char_length(col)


@F.pandas_udf(T.StringType())
def _unescape_all(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(html.unescape, na_action="ignore")


def unescape(col: Column, entities: str = "all") -> Column:
    """Decode HTML entities: ``all`` of the HTML5 table, or the ``basic`` ones natively.

    Rows without an ampersand never reach Python: they are sent as nulls.
    """
    if entities == "basic":
        for entity, char in BASIC_ENTITIES:
            col = F.replace(col, F.lit(entity), F.lit(char))
        return col
    if entities != "all":
        raise ValueError("entities must be 'all' or 'basic'")
    marked = F.when(F.contains(col, F.lit("&")), col)
    return F.coalesce(_unescape_all(marked), col)


def outbound_links(col: Column, excluded_hosts: Sequence[str] = EXCLUDED_HOSTS) -> Column:
    """Whitespace-separated http(s) links whose host is not excluded, in order."""
    def is_outbound(token: Column) -> Column:
        host = F.regexp_extract(token, r"^https?://([^/?#]*)", 1)
        return token.rlike(r"^https?://") & ~host.isin(*excluded_hosts)

    # split() into links only after a cheap containment test on the whole text
    linked = F.contains(col, F.lit("http://")) | F.contains(col, F.lit("https://"))
    tokens = F.when(linked, F.split(col, rf"{SPACE}+"))
    return F.coalesce(F.filter(tokens, is_outbound), F.array().cast("array<string>"))


def parse_decision(answer: Column) -> tuple[Column, Column]:
    """Decision and explanation of a free-text answer, marked or not."""
    marked = F.contains(answer, F.lit(DECISION_MARK)) & F.contains(answer, F.lit(EXPLANATION_MARK))
    part = F.split_part(
        F.split_part(answer, F.lit(DECISION_MARK), F.lit(2)), F.lit(EXPLANATION_MARK), F.lit(1)
    )
    # only the prefix of an unmarked answer is lowered; lowering can lengthen it
    prefix = F.substring(F.lower(F.substring(answer, 1, UNMARKED_PREFIX)), 1, UNMARKED_PREFIX)
    decisive = F.when(marked, F.lower(part)).otherwise(prefix)
    decision = (
        F.when(answer.isNull(), F.lit(ERROR))
        .when(F.contains(decisive, F.lit("yes")), F.lit(YES))
        .when(F.contains(decisive, F.lit("no")), F.lit(NO))
        .otherwise(F.lit(UNCLEAR))
    )
    reason = strip(F.split_part(answer, F.lit(EXPLANATION_MARK), F.lit(2)))
    explanation = (
        F.when(answer.isNull(), F.lit("null response")).when(marked, reason).otherwise(answer)
    )
    return decision, explanation


def parse_context_decision(answer: Column) -> tuple[Column, Column]:
    """``Decision: Yes/No`` anywhere in the answer, any case; the answer explains itself."""
    upper = F.upper(answer)
    decision = (
        F.when(answer.isNull(), F.lit(ERROR))
        .when(F.contains(upper, F.lit("DECISION: YES")), F.lit(YES))
        .when(F.contains(upper, F.lit("DECISION: NO")), F.lit(NO))
        .otherwise(F.lit(UNCLEAR))
    )
    return decision, F.coalesce(answer, F.lit("null response"))


def tokens(col: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(rf"{WORD}{{2,}}"), 0)


def escape_markup(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def friendly_name(col: Column) -> Column:
    """Display name of a prediction column: without ``_Binary``."""
    return F.replace(col, F.lit("_Binary"), F.lit(""))
