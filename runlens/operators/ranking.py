"""First rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    spread: int = 32,
) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank from 1.

    Each input task keeps n rows per group before the shuffle (WindowGroupLimit).
    What is left of a group then goes to ``spread`` tasks by its origin task, and
    only n rows from each of those meet in one task, so a group that holds most
    of the table is never gathered. ``spread=1`` leaves that step out, for tables
    that are small already.
    """
    final = Window.partitionBy(*group).orderBy(*order)
    if spread == 1:
        return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)
    df = df.withColumn("_origin", F.pmod(F.spark_partition_id(), F.lit(spread)))
    partial = Window.partitionBy(*group, "_origin").orderBy(*order)
    return (
        df.withColumn(rank, F.row_number().over(partial))
        .filter(F.col(rank) <= n)
        .drop("_origin", rank)
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= n)
    )
