"""What the plans must look like for tables that fit nowhere."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from runlens.operators import errors, joins, metrics, scoring
from runlens.operators.cleaning import clean_posts
from runlens.operators.ranking import top_n_per_group
from runlens.operators.retrieval import attach_context
from runlens.plans import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_skew_limits(spark):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        yield


def hot(spark, n=60000):
    """Posts where one id holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    return spark.range(n, numPartitions=8).select(
        key.alias("post_id"), (F.col("id") % 2).cast("int").alias("f"), F.col("id").alias("ingest_seq"),
        F.md5(F.col("id").cast("string")).alias("text"),
    )


def test_hot_post_is_split_in_compare_runs(spark, small_skew_limits):
    rows = hot(spark)
    side = joins.compare_runs(rows, rows, ("A", "B"), "post_id", ["post_id", "text"], ["f"])
    assert "skew=true" in final_plan(side)
    assert side.count() == 60000


def test_hot_post_is_split_in_skip_scored_and_fallback(spark, small_skew_limits):
    rows = hot(spark)
    previous = rows.filter("post_id > 30000").withColumn("scored_at", F.current_timestamp())
    left = joins.skip_scored(rows, previous, F.current_timestamp(), 30, keys=["post_id"])
    assert "skew=true" in final_plan(left)
    found = spark.range(3000).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(1).alias("rank"))
    chunks = spark.range(3000).select(F.col("id").alias("vec_id"), F.lit("chunk").alias("chunk"))
    assert "skew=true" in final_plan(scoring.with_fallback(rows, attach_context(found, chunks)))


def test_pivot_groups_numbers_not_texts(spark):
    parsed = spark.range(5).select(
        F.col("id").alias("_row"), F.col("id").alias("post_id"), F.lit("long text").alias("text"),
        F.lit("D").alias("definition"), F.lit("Yes").alias("decision"), F.lit("e").alias("explanation"),
    )
    plan = scoring.pivot_results(parsed, ["post_id", "text"], ["D"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert not any("text" in line for line in plan.splitlines() if "HashAggregate(keys" in line and "_digest" not in line)


def test_slices_shuffle_counts_not_rows(spark):
    rows = fx.classified(spark, SF_DIR)
    models = {"A": "pred_a", "B": "pred_b"}
    for df in (
        errors.errors_by_keyword(rows, "truth", models),
        errors.errors_by_length(rows, "truth", models),
        metrics.classification_metrics(rows, "truth", models),
        metrics.relative_improvement(metrics.classification_metrics(rows, "truth", models), "A", "B"),
        metrics.confusion_table(rows, "truth", "pred_a"),
    ):
        text = plan(df)
        assert text.count("FileScan") == 1
        assert "Join" not in text
        # a partial aggregate sits between the scan and the exchange nearest to it
        below = text[text.rindex("Exchange") :]
        assert "partial_count" in below


def test_scans_are_pruned_and_filtered(spark):
    rows = fx.classified(spark, SF_DIR)
    text = plan(metrics.confusion_counts(rows, "truth", "pred_a"))
    schema = text[text.index("ReadSchema") :]
    assert "l_discount" in schema and "l_extendedprice" not in schema and "l_orderkey" not in schema
    orders = fx.table(spark, SF_DIR, "orders")
    from runlens.operators.shape import filter_eq

    assert "EqualTo(o_orderstatus,F)" in plan(filter_eq(orders, o_orderstatus="F").select("o_orderkey"))


def test_native_cleaning_stays_in_the_jvm(spark):
    documents = fx.table(spark, SF_DIR, "documents").select("doc_id", "text")
    text = plan(clean_posts(documents, entities="basic"))
    assert "Python" not in text and "Exchange" not in text


def test_top_n_does_not_gather_a_group(spark):
    rows = spark.range(1000, numPartitions=8).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5))
    top = top_n_per_group(rows, ["g"], [F.desc("id")], 3)
    text = plan(top)
    # before each of the two shuffles every task keeps n rows per group
    assert text.count("WindowGroupLimit") == 4 and text.count("Exchange") == 2
    want = {}
    for i in range(999, -1, -1):
        want.setdefault(0 if i % 3 == 0 else i % 5, []).append(i)
    got = {}
    for r in top.orderBy("g", "rank").collect():
        got.setdefault(r["g"], []).append(r["id"])
    assert got == {g: ids[:3] for g, ids in want.items()}
