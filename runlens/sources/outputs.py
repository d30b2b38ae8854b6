"""Outputs of a two-run comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from runlens.operators.errors import error_change_rows
from runlens.sources.tables import CSV_READ, write_table


def write_comparison(
    stacked: DataFrame,
    compare: Callable[[DataFrame], DataFrame],
    out_dir: str,
    names: tuple[str, str],
    fmt: str = "parquet",
) -> tuple[str, str]:
    """Write the stacked runs, then the side-by-side table derived from that output.

    ``compare`` maps the stacked table to the side-by-side one. Reading the first
    output back means the runs are computed once, however costly they were.
    """
    label = f"{names[0]}_vs_{names[1]}"
    stacked_path = f"{out_dir.rstrip('/')}/combined_model_results_{label}"
    side_path = f"{out_dir.rstrip('/')}/comparative_model_results_{label}"
    write_table(stacked, stacked_path, fmt)
    reader = stacked.sparkSession.read.schema(stacked.schema)
    if fmt == "csv":
        reader = reader.options(**CSV_READ, multiLine=True)
    write_table(compare(reader.format(fmt).load(stacked_path)), side_path, fmt)
    return stacked_path, side_path


def write_error_examples(
    df: DataFrame, path: str, truth: str, base: str, new: str, fmt: str = "parquet"
) -> None:
    """Rows whose error was fixed or introduced, one folder per kind of change."""
    write_table(error_change_rows(df, truth, base, new), path, fmt, ["change_class"])


