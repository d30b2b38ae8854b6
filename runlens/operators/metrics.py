"""Confusion counts and the metrics derived from them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.rates import metric_columns, ratio

# Metrics shown side by side, and the one where lower is better.
COMPARED = ("precision", "specificity", "false_positive_rate", "f05", "f1", "recall", "mcc")
LOWER_IS_BETTER = "false_positive_rate"
BASELINE_FLOOR = 0.0001


def cell_counts(truth: str, pred: str) -> dict[str, Column]:
    """The four confusion cells as aggregates; null truth or prediction is in none."""
    t, p = F.col(truth), F.col(pred)
    return {
        "tn": F.count_if((t == 0) & (p == 0)),
        "fp": F.count_if((t == 0) & (p == 1)),
        "fn": F.count_if((t == 1) & (p == 0)),
        "tp": F.count_if((t == 1) & (p == 1)),
    }


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row with tn, fp, fn and tp; all four are there with one class too."""
    return df.agg(*(c.alias(name) for name, c in cell_counts(truth, pred).items()))


def counts_by_model(df: DataFrame, truth: str, predictions: Mapping[str, str]) -> DataFrame:
    """A row of cells per model from one pass; rows are not multiplied by models."""
    aggregates = [F.count("*").alias("n_rows")]
    for i, pred in enumerate(predictions.values()):
        aggregates += [c.alias(f"{cell}_{i}") for cell, c in cell_counts(truth, pred).items()]
    per_model = F.array(
        *(
            F.struct(
                F.lit(model).alias("model"),
                *(F.col(f"{cell}_{i}").alias(cell) for cell in ("tn", "fp", "fn", "tp")),
            )
            for i, model in enumerate(predictions)
        )
    )
    return df.agg(*aggregates).select("n_rows", F.inline(per_model))


def classification_metrics(df: DataFrame, truth: str, predictions: Mapping[str, str]) -> DataFrame:
    """One row per model: nine metrics, eight counts, and how many rows had no score.

    ``predictions`` maps model name to prediction column.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scored = tp + fp + tn + fn
    return counts_by_model(df, truth, predictions).select(
        "model",
        *(c.alias(name) for name, c in metric_columns(tp, fp, tn, fn).items()),
        tp.alias("true_positive"),
        fp.alias("false_positive"),
        tn.alias("true_negative"),
        fn.alias("false_negative"),
        (tp + fp).alias("total_predicted_positive"),
        (tp + fn).alias("total_actual_positive"),
        (tn + fp).alias("total_actual_negative"),
        scored.alias("total_samples"),
        (F.col("n_rows") - scored).alias("n_unscored"),
    )


def compare_models(metrics: DataFrame) -> DataFrame:
    """Seven metrics side by side, one row per model."""
    return metrics.select("model", *COMPARED)


def relative_improvement(metrics: DataFrame, base: str, new: str) -> DataFrame:
    """Relative change per metric from model ``base`` to model ``new``.

    The sign is turned for the false positive rate, a baseline near zero is
    replaced by a floor, and ``direction`` tells which way the metric moved. Both
    models are taken from one pass over ``metrics``.
    """
    def value(metric: str, model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(metric)))

    pairs = [
        F.struct(
            F.lit(metric).alias("metric"),
            value(metric, base).alias("base_value"),
            value(metric, new).alias("new_value"),
        )
        for metric in COMPARED
    ]
    floor = F.when(F.abs("base_value") < BASELINE_FLOOR, F.lit(BASELINE_FLOOR)).otherwise(
        F.col("base_value")
    )
    change = (F.col("new_value") - floor) / floor
    moved = F.col("new_value") - F.col("base_value")
    return metrics.agg(F.array(*pairs).alias("_pairs")).select(F.inline("_pairs")).select(
        "metric",
        "base_value",
        "new_value",
        F.when(F.col("metric") == LOWER_IS_BETTER, -change).otherwise(change).alias("improvement"),
        F.when(moved > 0, "increase").when(moved < 0, "decrease").otherwise("none").alias("direction"),
    )


def confusion_table(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Crosstab with margins (``All``) and the share of each row, 0 for missing cells.

    Rows are counted first, so the cube runs over at most four rows.
    """
    # four literal zero cells make every cell exist
    classes = F.array(*(F.lit(i) for i in (0, 1)))
    zeros = (
        df.sparkSession.range(1)
        .select(F.explode(classes).alias("actual"), classes.alias("_p"))
        .select("actual", F.explode("_p").alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    )
    counted = (
        df.filter(F.col(truth).isin(0, 1) & F.col(pred).isin(0, 1))
        .groupBy(F.col(truth).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted"))
        .agg(F.count("*").alias("n"))
    )
    cells = counted.unionByName(zeros).cube("actual", "predicted").agg(
        F.sum("n").alias("count"),
        F.grouping("actual").alias("_a"),
        F.grouping("predicted").alias("_p"),
    )
    named = cells.select(
        F.when(F.col("_a") == 1, "All").otherwise(F.col("actual").cast("string")).alias("actual"),
        F.when(F.col("_p") == 1, "All").otherwise(F.col("predicted").cast("string")).alias("predicted"),
        "count",
    )
    # nine rows: the row margin is looked up within each of three groups
    of_row = F.max(F.when(F.col("predicted") == "All", F.col("count"))).over(Window.partitionBy("actual"))
    return named.withColumn("_row", of_row).select(
        "actual", "predicted", "count", (ratio(F.col("count"), F.col("_row")) * 100).alias("row_percent")
    )
