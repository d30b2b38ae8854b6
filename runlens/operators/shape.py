"""Row shaping: filters, flags, bins, batches, unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import NO, UNCLEAR, ERROR, YES, text_length
from runlens.sources.storage import materialize

# What is read as a positive label, length bin edges and their labels.
POSITIVES = ("Yes", "yes", "Y", "y", "1", 1, True)
LENGTH_EDGES = (0, 80, 120, 160, 200, 240, 280, 320, 400, 600, 1000)
LENGTH_LABELS = (
    "0-80", "81-120", "121-160", "161-200", "201-240",
    "241-280", "281-320", "321-400", "401-600", "601+",
)

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row below
_LOCAL_ROW = (1 << _LOCAL_BITS) - 1


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def filter_eq(df: DataFrame, **equals) -> DataFrame:
    """Rows equal to every given value; unknown column names are ignored."""
    known = [F.col(name) == F.lit(value) for name, value in equals.items() if name in df.columns]
    return df.filter(reduce(Column.__and__, known)) if known else df


def limit_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """First ``n`` rows by ``order``; 0 or None keeps all."""
    return df.orderBy(*order).limit(n) if n else df


def with_positions(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in ``order``; ties keep their input order.

    Range partitions are sorted locally, written once with their partition number
    and local row number, and counted. The only table that reaches one task is the
    list of counts, one row per range partition. The input order breaks ties, so
    equal keys spread over as many partitions as they need.
    """
    arrived = df.withColumn("_arrival", F.monotonically_increasing_id())
    keys = [*order, "_arrival"]
    ranged = arrived.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_arrival")
    stamped = materialize(ranged.withColumn("_slot", F.monotonically_increasing_id()), "positions")
    part = F.shiftrightunsigned("_slot", _LOCAL_BITS).cast("int")
    sizes = stamped.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    offsets, start = [], 0
    for row in sizes.orderBy("_part").collect():  # one row per range partition
        offsets.append((row["_part"], start))
        start += row["_size"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _start bigint")
    return (
        stamped.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_slot").bitwiseAND(F.lit(_LOCAL_ROW)))
        .drop("_part", "_start", "_slot")
    )


def assign_batches(df: DataFrame, size: int, *order: str, first_id: int = 0) -> DataFrame:
    """``batch_id`` = position div ``size``; the last batch may be short."""
    placed = with_positions(df, *order)
    batch = F.expr(f"position div {int(size)}") + F.lit(first_id)
    return placed.withColumn("batch_id", batch.cast("bigint"))


def to_binary(df: DataFrame, column: str, positives: Sequence = POSITIVES) -> DataFrame:
    """Add ``<column>_Binary``; an unknown column leaves the table as it is.

    Text is compared with the texts among ``positives``, numbers and booleans with
    the numbers; text that only looks like a boolean is not one.
    """
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    texts = [p for p in positives if isinstance(p, str)]
    numbers = [float(p) for p in positives if not isinstance(p, str)]
    if isinstance(kind, T.StringType):
        positive = F.col(column).isin(texts)
    else:
        positive = F.col(column).cast("double").isin(numbers)
    return df.withColumn(f"{column}_Binary", flag(positive))


def decision_flag(decision: Column) -> Column:
    return flag(decision == F.lit(YES))


def decision_map(decision: Column) -> Column:
    """Yes 1; No, Error and Unclear 0; anything else null."""
    return F.when(decision == YES, 1).when(decision.isin(NO, ERROR, UNCLEAR), 0)


def add_column(df: DataFrame, name: str, value: Column | DataFrame, key: str | None = None) -> DataFrame:
    """Attach an expression, or values from another table by key (one row per key)."""
    if isinstance(value, Column):
        return df.withColumn(name, value)
    return df.join(value.select(key, name), key, "left")


def project_rename(
    df: DataFrame, carry: Sequence[str], flags: Sequence[str], model: str
) -> DataFrame:
    """Carried columns as they are, flag columns suffixed with the model name."""
    return df.select(*carry, *(F.col(f).alias(f"{f}_{model}") for f in flags))


def with_text_length(df: DataFrame, text: str = "text") -> DataFrame:
    """Code-point length, added only if the table has none."""
    if "text_length" in df.columns:
        return df
    return df.withColumn("text_length", text_length(F.col(text)))


def false_positives(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.filter((F.col(truth) == 0) & (F.col(pred) == 1))


def false_negatives(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.filter((F.col(truth) == 1) & (F.col(pred) == 0))


def error_flags(df: DataFrame, truth: str, *preds: str) -> DataFrame:
    """Per prediction column: ``<pred>_FP`` and ``<pred>_FN``, 0 where a value is missing."""
    wrong = {}
    for pred in preds:
        wrong[f"{pred}_FP"] = flag((F.col(truth) == 0) & (F.col(pred) == 1))
        wrong[f"{pred}_FN"] = flag((F.col(truth) == 1) & (F.col(pred) == 0))
    return df.withColumns(wrong)


def length_bin(
    length: Column,
    edges: Sequence[int] = LENGTH_EDGES,
    labels: Sequence[str] = LENGTH_LABELS,
    open_ended: bool = False,
) -> tuple[Column, Column]:
    """Label and ordinal of the right-closed bin ``(lo, hi]``; null outside the edges.

    ``open_ended`` also takes the lowest edge itself and everything above the last.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    label, ordinal = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        low = length >= edges[i] if open_ended and i == 0 else length > edges[i]
        inside = low if open_ended and i == len(labels) - 1 else low & (length <= edges[i + 1])
        label = F.when(inside, F.lit(labels[i])).otherwise(label)
        ordinal = F.when(inside, F.lit(i)).otherwise(ordinal)
    return label, ordinal


def stack(*tables) -> DataFrame:
    """Union by name, missing columns null; arguments that are no tables are ignored."""
    frames = [t for t in tables if isinstance(t, DataFrame)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_runs(runs: Mapping[str, DataFrame], decisions: Mapping[str, str]) -> DataFrame:
    """Tag runs with their model and add one flag per decision column, then stack.

    ``decisions`` maps flag name to decision column.
    """
    tagged = [
        df.withColumns(
            {"model": F.lit(model), **{f: decision_flag(F.col(c)) for f, c in decisions.items()}}
        )
        for model, df in runs.items()
    ]
    return stack(*tagged)


def drop_identical_results(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
