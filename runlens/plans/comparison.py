"""From two scored runs to their comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.errors import (
    compare_model_errors,
    error_change_rows,
    error_rates_all_slices,
)
from runlens.operators.joins import compare_runs
from runlens.operators.metrics import classification_metrics, compare_models, relative_improvement
from runlens.operators.shape import stack_runs
from runlens.operators.topics import TopicResult, fp_topics
from runlens.sources.outputs import write_comparison
from runlens.sources.storage import materialize


def merge_runs(
    base: DataFrame,
    new: DataFrame,
    names: tuple[str, str],
    definitions: list[str],
    out_dir: str,
    carry: list[str],
    order: str = "ingest_seq",
    fmt: str = "parquet",
) -> tuple[str, str]:
    """Write both runs stacked and side by side; flags come from ``<definition>_Decision``."""
    flags = {f"{d}_Binary": f"{d}_Decision" for d in definitions}
    stacked = stack_runs({names[0]: base, names[1]: new}, flags)

    def side_by_side(written: DataFrame) -> DataFrame:
        return compare_runs(
            written.filter(F.col("model") == names[0]),
            written.filter(F.col("model") == names[1]),
            names,
            "post_id",
            carry,
            list(flags),
            order,
        )

    return write_comparison(stacked, side_by_side, out_dir, names, fmt)


@dataclass(frozen=True)
class Analysis:
    metrics: DataFrame
    comparison: DataFrame
    improvement: DataFrame
    slices: DataFrame
    error_changes: DataFrame
    changed_rows: DataFrame
    topics: dict[str, TopicResult]


def analyse_runs(
    side_by_side: DataFrame,
    truth: str,
    base: str,
    new: str,
    topics: bool = False,
    k: int = 5,
    max_iter: int = 100,
    **topic_settings,
) -> Analysis:
    """Everything that is reported about two prediction columns of one table.

    ``topic_settings`` are further arguments of ``fp_topics``: seed, min_df, max_df,
    stop_words, max_vocabulary.
    """
    columns = {name.replace("_Binary", ""): name for name in (base, new)}
    first, second = columns
    # one row per model, written so that its three uses share one scan
    metrics = materialize(classification_metrics(side_by_side, truth, columns), "metrics")
    return Analysis(
        metrics=metrics,
        comparison=compare_models(metrics),
        improvement=relative_improvement(metrics, first, second),
        slices=error_rates_all_slices(side_by_side, truth, columns),
        error_changes=compare_model_errors(side_by_side, truth, base, new),
        changed_rows=error_change_rows(side_by_side, truth, base, new),
        topics={
            model: fp_topics(side_by_side, truth, column, k, max_iter=max_iter, **topic_settings)
            for model, column in columns.items()
            if topics
        },
    )
