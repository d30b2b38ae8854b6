"""Error rates by slice, error changes between two runs, examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.rates import metric_columns, ratio
from runlens.operators.metrics import cell_counts
from runlens.operators.ranking import top_n_per_group
from runlens.operators.shape import (
    LENGTH_EDGES,
    LENGTH_LABELS,
    error_flags,
    length_bin,
    with_text_length,
)

CELLS = ("tn", "fp", "fn", "tp")
COUNTS = ("n", "negative_count", "positive_count", *CELLS)


def slice_cells(
    df: DataFrame, truth: str, predictions: Mapping[str, str], by: Sequence[Column]
) -> DataFrame:
    """Counts per slice and model from one scan and one shuffle of partial counts.

    All models are counted in the same row and only the grouped result is turned
    into a row per model; a hot slice is one row per map task.
    """
    names = [f"_by_{i}" for i in range(len(by))]
    aggregates = [
        F.count("*").alias("n"),
        F.count_if(F.col(truth) == 0).alias("negative_count"),
        F.count_if(F.col(truth) == 1).alias("positive_count"),
    ]
    for i, pred in enumerate(predictions.values()):
        aggregates += [c.alias(f"{cell}_{i}") for cell, c in cell_counts(truth, pred).items()]
    per_model = F.array(
        *(
            F.struct(F.lit(m).alias("model"), *(F.col(f"{c}_{i}").alias(c) for c in CELLS))
            for i, m in enumerate(predictions)
        )
    )
    grouped = df.groupBy(*(c.alias(n) for c, n in zip(by, names))).agg(*aggregates)
    return grouped.select(
        *names, "n", "negative_count", "positive_count", F.inline(per_model)
    )


def _slice_columns() -> list[Column]:
    fp, fn = F.col("fp"), F.col("fn")
    return [
        F.col("n"),
        F.col("negative_count"),
        F.col("positive_count"),
        fp.alias("false_positive_count"),
        fn.alias("false_negative_count"),
        ratio(fp, F.col("negative_count")).alias("false_positive_rate"),
        ratio(fn, F.col("positive_count")).alias("false_negative_rate"),
        ratio(fp + fn, F.col("n")).alias("error_rate"),
    ]


def errors_by_length(
    df: DataFrame,
    truth: str,
    predictions: Mapping[str, str],
    edges: Sequence[int] = LENGTH_EDGES,
    labels: Sequence[str] = LENGTH_LABELS,
    open_ended: bool = False,
    text: str = "text",
) -> DataFrame:
    """Error counts and rates per length bin and model; empty bins are left out.

    ``bin_ord`` is the order of the bins.
    """
    df = with_text_length(df, text)
    _, ordinal = length_bin(F.col("text_length"), edges, labels, open_ended)
    names = F.array(*(F.lit(label) for label in labels))
    return (
        slice_cells(df, truth, predictions, [ordinal])
        .filter(F.col("_by_0").isNotNull())
        .select(
            "model",
            F.get(names, F.col("_by_0")).alias("length_bin"),
            F.col("_by_0").alias("bin_ord"),
            *_slice_columns(),
        )
    )


def errors_by_keyword(
    df: DataFrame,
    truth: str,
    predictions: Mapping[str, str],
    keyword: str = "keyword",
    min_count: int = 5,
) -> DataFrame:
    """Error counts and rates per keyword and model; rare keywords are left out."""
    kept = df.filter(F.col(keyword).isNotNull())
    return (
        slice_cells(kept, truth, predictions, [F.col(keyword)])
        .filter(F.col("n") >= min_count)
        .select("model", F.col("_by_0").alias("keyword"), *_slice_columns())
    )


def by_error_rate(slices: DataFrame, label: str = "keyword") -> DataFrame:
    """Worst first, ties by label."""
    return slices.orderBy("model", F.desc("error_rate"), label)


def error_rates_all_slices(
    df: DataFrame,
    truth: str,
    predictions: Mapping[str, str],
    keyword: str = "keyword",
    min_count: int = 5,
    edges: Sequence[int] = LENGTH_EDGES,
    labels: Sequence[str] = LENGTH_LABELS,
    open_ended: bool = False,
) -> DataFrame:
    """Overall, per-length and per-keyword errors of all models from one scan.

    Rows are counted once per (bin, keyword); the grouping sets then run over those
    counts and not over the rows, so nothing of table size is expanded.
    """
    df = with_text_length(df)
    _, ordinal = length_bin(F.col("text_length"), edges, labels, open_ended)
    finest = slice_cells(df, truth, predictions, [ordinal, F.col(keyword)]).select(
        "model", F.col("_by_0").alias("bin_ord"), F.col("_by_1").alias("keyword"), *COUNTS
    )
    model, bins, keywords = F.col("model"), F.col("bin_ord"), F.col("keyword")
    rolled = finest.groupingSets([[model], [model, bins], [model, keywords]], model, bins, keywords).agg(
        *(F.sum(c).alias(c) for c in COUNTS), F.grouping_id().alias("_level")
    )
    # grouping id: bit 2 model, bit 1 bin, bit 0 keyword; a set bit is rolled up
    overall, per_bin, per_keyword = 3, 1, 2
    level = F.col("_level")
    kept = rolled.filter(
        (level == overall)
        | ((level == per_bin) & bins.isNotNull())
        | ((level == per_keyword) & keywords.isNotNull() & (F.col("n") >= min_count))
    )
    names = F.array(*(F.lit(label) for label in labels))
    metrics = metric_columns(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    return kept.select(
        "model",
        F.when(level == overall, "all").when(level == per_bin, "length").otherwise("keyword").alias("slice"),
        F.when(level == per_bin, F.get(names, bins)).otherwise(keywords).alias("slice_value"),
        bins.alias("bin_ord"),
        *_slice_columns(),
        *(metrics[m].alias(m) for m in ("precision", "recall", "f1", "f05", "mcc")),
    )


def _error_change(base: str, new: str) -> Column:
    """Kind of change of a row with error flags, null when there was no error."""
    def change(kind: str) -> Column:
        before, after = F.col(f"{base}_{kind}") == 1, F.col(f"{new}_{kind}") == 1
        name = kind.lower()
        return (
            F.when(before & ~after, f"{name}_fixed")
            .when(~before & after, f"{name}_introduced")
            .when(before & after, f"{name}_persistent")
        )

    return F.coalesce(change("FP"), change("FN"))


CHANGES = ("fixed", "introduced", "persistent")


def compare_model_errors(df: DataFrame, truth: str, base: str, new: str) -> DataFrame:
    """One row: false positives and negatives fixed, introduced and persistent, and nets."""
    changed = error_flags(df, truth, base, new).withColumn("_change", _error_change(base, new))
    counts = changed.agg(
        *(
            F.count_if(F.col("_change") == f"{kind}_{change}").alias(f"{kind}_{change}")
            for kind in ("fp", "fn")
            for change in CHANGES
        )
    )
    fp_net = F.col("fp_fixed") - F.col("fp_introduced")
    fn_net = F.col("fn_fixed") - F.col("fn_introduced")
    return counts.select(
        "*",
        fp_net.alias("fp_net_improvement"),
        fn_net.alias("fn_net_improvement"),
        (fp_net + fn_net).alias("overall_net_improvement"),
    )


def error_change_rows(df: DataFrame, truth: str, base: str, new: str) -> DataFrame:
    """The rows behind fixed and introduced errors, with their ``change_class``."""
    flagged = error_flags(df, truth, base, new)
    changed = flagged.withColumn("change_class", _error_change(base, new))
    return changed.filter(~F.col("change_class").endswith("_persistent"))


def top_keywords(slices: DataFrame, by: str = "error_rate", n: int = 15) -> DataFrame:
    """The ``n`` worst keywords of each model by one of the three rates."""
    return top_n_per_group(slices, ["model"], [F.desc(by), F.asc("keyword")], n, spread=1)


def sample_errors(
    df: DataFrame,
    truth: str,
    pred: str,
    kind: str = "both",
    n: int = 10,
    seed: int = 42,
    key: str = "post_id",
    columns: Sequence[str] = ("text", "keyword"),
) -> DataFrame:
    """Up to ``n`` false positives and/or negatives in a seeded pseudo-random order."""
    t, p = F.col(truth), F.col(pred)
    error_type = F.when((t == 0) & (p == 1), "fp").when((t == 1) & (p == 0), "fn")
    wanted = ["fp", "fn"] if kind == "both" else [kind]
    errors = df.withColumn("error_type", error_type).filter(F.col("error_type").isin(*wanted))
    picked = errors.select("error_type", key, *columns, sample_order(key, seed).alias("_order"))
    return top_n_per_group(
        picked, ["error_type"], [F.col("_order"), F.col(key)], n, rank="sample_rank"
    ).drop("_order")


def sample_order(key: str, seed: int) -> Column:
    """A seeded order any engine can repeat: the digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
