"""Session settings the jobs are written for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

# Adaptive execution sizes partitions and splits skewed join partitions at run
# time; exchanges start with as many partitions as ``input_bytes`` asks for.
PARTITION_BYTES = 128 << 20
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    app_name: str = "runlens",
    master: str | None = None,
    extra: Mapping[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """A session with the settings above, overridden by ``extra``.

    ``input_bytes`` is the size of the input: range and hash exchanges start with a
    partition per 128 MB of it, 200 at least, and adaptive execution merges small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    sized = {}
    if input_bytes is not None:
        partitions = str(max(200, -(-input_bytes // PARTITION_BYTES)))
        sized = {
            "spark.sql.shuffle.partitions": partitions,
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": partitions,
        }
    for key, value in {**RECOMMENDED, **sized, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
