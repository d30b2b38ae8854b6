"""Long tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARTED_METRICS = ("precision", "specificity", "f05", "f1", "recall")


def metrics_long(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot(["model"], list(CHARTED_METRICS), "metric", "value")


def length_rates_long(slices: DataFrame) -> DataFrame:
    rates = slices.select(
        "model",
        "length_bin",
        "bin_ord",
        F.col("false_positive_rate").alias("fp"),
        F.col("false_negative_rate").alias("fn"),
    )
    return rates.unpivot(["model", "length_bin", "bin_ord"], ["fp", "fn"], "error_type", "rate")


def keyword_labels(top: DataFrame, by: str = "error_rate") -> DataFrame:
    """Count label of each bar: errors over their base, or both errors over all rows."""
    fp, fn = F.col("false_positive_count"), F.col("false_negative_count")
    label = {
        "false_positive_rate": F.concat(fp, F.lit("/"), F.col("negative_count")),
        "false_negative_rate": F.concat(fn, F.lit("/"), F.col("positive_count")),
        "error_rate": F.concat(fp, F.lit("FP + "), fn, F.lit("FN/"), F.col("n")),
    }[by]
    return top.select("model", "keyword", F.col(by).alias("rate"), label.alias("label"))


def error_changes_long(changes: DataFrame) -> DataFrame:
    """Fixed, introduced and persistent counts per error type, from the summary row."""
    cells = [
        F.struct(
            F.lit(change).alias("change"),
            F.lit(kind).alias("error_type"),
            F.col(f"{kind}_{change}").alias("count"),
        )
        for change in ("fixed", "introduced", "persistent")
        for kind in ("fp", "fn")
    ]
    return changes.select(F.inline(F.array(*cells)))
