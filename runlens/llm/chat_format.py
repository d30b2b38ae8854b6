"""Chat formatting: typed content parts become one string with a loss mask.

A turn's content is an array of parts ``(type, text, ref, units)``. A visitor over
the parts writes text parts escaped, and image, audio and document parts as a
placeholder each; it records the attachment with its reference and the number of
tokens the placeholder expands to. Turns are marked by control strings. A control
string inside a text is broken by a backslash after its first character, and a
backslash is doubled, so the text can be read back exactly.

Defined cases: a null text or role counts as empty; null parts, and parts of an
unknown type, give nothing; turns are ordered by turn (null first), then role, then
content, and repeated rows stay repeated; rows without conversation id form one
conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, CONTENT, END = "<|start|>", "<|content|>", "<|end|>"
ATTACHED = ("image", "audio", "document")
# Tokens one unit of an attachment expands to: a tile, a second, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"

# A backslash, or the first character of a control string of this or another template.
_TO_ESCAPE = r"(\\|[<\[](?=\|[A-Za-z_]+\|>|/?s>|</?SYS>>|/?INST\]))"
_ESCAPED = r"(?s)\\(.)"
_PLACEHOLDER = r"<\|(?:image|audio|document)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _TO_ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def text_part(text: Column) -> Column:
    """Content of a text-only turn."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("units"),
        )
    )


def _written(part: Column) -> Column:
    kind = part["type"]
    placeholder = F.concat(F.lit("<|"), kind, F.lit("|>"))
    return (
        F.when(kind == "text", escape(part["text"]))
        .when(kind.isin(*ATTACHED), placeholder)
        .otherwise(F.lit(""))
    )


def _attachment(part: Column, tokens_per_unit: Mapping[str, int]) -> Column:
    per_unit = F.lit(0)
    for kind, tokens in tokens_per_unit.items():
        per_unit = F.when(part["type"] == kind, F.lit(tokens)).otherwise(per_unit)
    return F.struct(
        part["type"].alias("type"),
        part["ref"].alias("ref"),
        (F.coalesce(part["units"], F.lit(1)) * per_unit).cast("long").alias("tokens"),
    )


def format_chats(
    turns: DataFrame,
    loss_role: str = "assistant",
    tokens_per_unit: Mapping[str, int] = TOKENS_PER_UNIT,
) -> DataFrame:
    """One row per conversation of ``turns`` (``conv_id, turn, role, content``).

    ``formatted`` is the string, ``loss_spans`` the (start, length) in code points
    that the loss covers, ``attachments`` the placeholders' references and expanded
    token counts in order.
    """
    parts = F.filter("content", lambda p: p.isNotNull())
    written = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce(F.array_join(F.transform(parts, _written), ""), F.lit("")).alias("body"),
        F.coalesce(
            F.transform(
                F.filter(parts, lambda p: p["type"].isin(*ATTACHED)),
                lambda p: _attachment(p, tokens_per_unit),
            ),
            F.expr("array()").cast("array<struct<type:string,ref:string,tokens:bigint>>"),
        ).alias("attachments"),
    )
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(CONTENT))
    sized = written.withColumns(
        {"head_chars": F.char_length(head), "body_chars": F.char_length("body")}
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    block_chars = F.col("head_chars") + F.col("body_chars") + len(END)
    placed = sized.withColumns(
        {
            "position": F.row_number().over(order),
            "block_end": F.sum(block_chars).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    turn = F.struct(
        "position",
        "role",
        F.concat(head, F.col("body"), F.lit(END)).alias("block"),
        F.struct(
            (F.col("block_end") - len(END) - F.col("body_chars")).alias("start"),
            F.col("body_chars").cast("long").alias("length"),
        ).alias("span"),
        "attachments",
    )
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["span"]
        ).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted string; attachments have no text."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b.startswith(START))

    def read(block: Column) -> Column:
        pair = F.split(F.substring(block, len(START) + 1, 2147483647), r"<\|content\|>")
        text = F.regexp_replace(pair.getItem(1), _PLACEHOLDER, "")
        return F.struct(unescape(pair.getItem(0)).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, read)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""

    def read(span: Column) -> Column:
        under = F.substr(formatted, (span["start"] + 1).cast("int"), span["length"].cast("int"))
        return unescape(F.regexp_replace(under, _PLACEHOLDER, ""))

    return F.array_join(F.transform(spans, read), "")
