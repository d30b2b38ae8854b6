"""Rates over confusion counts, in double, zero when undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(value, F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    weight = beta * beta
    hits = tp.cast("double") * (1.0 + weight)
    return ratio(hits, hits + fn * weight + fp)


def matthews(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    # doubles before multiplying: the product of four long counts overflows
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    return ratio(
        tp * tn - fp * fn,
        F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)),
    )


def balanced_accuracy(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Mean of the per-class recalls over the classes the truth contains."""
    recalls = ratio(tp, tp + fn) + ratio(tn, tn + fp)
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return ratio(recalls, classes)


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "f1": f_beta(tp, fp, fn, 1.0),
        "f05": f_beta(tp, fp, fn, 0.5),
        "mcc": matthews(tp, fp, tn, fn),
        "balanced_accuracy": balanced_accuracy(tp, fp, tn, fn),
        "false_positive_rate": ratio(fp, tn + fp),
    }
