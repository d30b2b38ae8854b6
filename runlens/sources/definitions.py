"""Definition templates: one text file each, the file stem is the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEM = r"([^/]+)\.txt(?:/part-[^/]*)?$"


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """``(definition, template)``; names compare case-insensitively, kept as written."""
    source = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    saved = source.rlike(r"\.txt/part-[^/]*$")  # one-row text output ends with a line feed
    value = F.when(saved, F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value"))
    return (
        spark.read.text(f"{path.rstrip('/')}/*.txt", wholetext=True)
        .select(
            F.regexp_extract(source, _STEM, 1).alias("definition"),
            value.alias("template"),
        )
    )


def save_definition(spark: SparkSession, path: str, name: str, template: str) -> None:
    """Save a template under ``<path>/<name>.txt`` on any file system Spark writes to."""
    row = spark.range(1).select(F.lit(template).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{name}.txt")


def missing_definitions(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names that no available definition carries."""
    have = available.select(F.lower("definition").alias("_have")).distinct()
    return (
        requested.select("definition").distinct()
        .join(have, F.lower("definition") == F.col("_have"), "left_anti")
    )
