"""Follow a folder of result files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runlens.operators.profile import decision_summary
from runlens.sources.tables import CSV_READ


def stream_batches(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Result files as a stream; each file is read once, whenever it arrives."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_READ, multiLine=True)
    return reader.format(fmt).load(path)


def summarise_arrivals(
    results: DataFrame,
    publish: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Decision counts per definition over everything that has arrived so far.

    Handles what is there and stops; run it again for newer files. The state is one
    row per definition, so it stays small without a watermark. ``publish`` gets the
    whole summary of each round.
    """
    return (
        decision_summary(results)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
