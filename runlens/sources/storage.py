"""The shared folder, written intermediates, and size checks for small sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.conf.get("spark.app.id")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="runlens-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses; each application has a folder of its own."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/runlens/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application left under the shared folder; others keep theirs.

    Call it when no result that was handed out will be read any more.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Cuts the lineage at a table that outlives executors, and keeps columnar
    reads: a later pass that needs two columns reads two columns.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, label)
    df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list[Row]:
    """Rows of a table that must be small; more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
