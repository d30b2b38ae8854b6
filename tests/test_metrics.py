"""Hand cases for metrics and slices, and the shape of their plans."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.operators import charts, errors, metrics, profile

ROWS = "truth int, pred int, keyword string, text string"


def one(df):
    return df.collect()[0].asDict()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metrics_against_formulas(spark):
    df = spark.createDataFrame(
        [(1, 1)] * 6 + [(0, 1)] * 3 + [(0, 0)] * 9 + [(1, 0)] * 2 + [(None, 1), (1, None)], "truth int, pred int"
    )
    m = one(metrics.classification_metrics(df, "truth", {"m": "pred"}))
    tp, fp, tn, fn = 6, 3, 9, 2
    assert (m["true_positive"], m["false_positive"], m["true_negative"], m["false_negative"]) == (tp, fp, tn, fn)
    assert m["n_unscored"] == 2 and m["total_samples"] == 20
    precision, recall = tp / 9, tp / 8
    assert m["precision"] == pytest.approx(precision)
    assert m["f05"] == pytest.approx(1.25 * precision * recall / (0.25 * precision + recall))
    assert m["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert m["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt(9 * 8 * 12 * 11))
    assert m["balanced_accuracy"] == pytest.approx((6 / 8 + 9 / 12) / 2)
    assert m["false_positive_rate"] == pytest.approx(3 / 12)


@pytest.mark.parametrize("rows", [[], [(0, 0)] * 4, [(1, 1)] * 4, [(0, 1)], [(None, None)]])
def test_one_class_or_nothing(spark, rows):
    df = spark.createDataFrame(rows, "truth int, pred int")
    m = one(metrics.classification_metrics(df, "truth", {"m": "pred"}))
    assert all(v is not None for v in m.values())
    assert m["total_samples"] == sum(t is not None for t, _ in rows)
    if rows and rows[0] == (0, 0):
        assert m["balanced_accuracy"] == 1.0 and m["mcc"] == 0.0


def test_confusion_table_fills_missing_cells(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(1, 0)], "truth int, pred int")
    cells = {(r["actual"], r["predicted"]): (r["count"], r["row_percent"]) for r in metrics.confusion_table(df, "truth", "pred").collect()}
    assert len(cells) == 9
    assert cells[("0", "1")] == (0, 0.0)
    assert cells[("1", "0")] == (1, 100.0)
    assert cells[("All", "All")] == (4, 100.0)


def test_relative_improvement(spark):
    base = {name: 0.5 for name in metrics.COMPARED}
    old = base | {"precision": 0.0, "recall": 0.00005, "mcc": -0.5, "false_positive_rate": 0.4}
    new = base | {"precision": 0.1, "recall": 0.2, "mcc": 0.25, "false_positive_rate": 0.3}
    rows = [("old", *old.values()), ("new", *new.values()), ("other", *base.values())]
    table = spark.createDataFrame(rows, "model string, " + ", ".join(f"{k} double" for k in base))
    got = {r["metric"]: r for r in metrics.relative_improvement(table, "old", "new").collect()}
    assert len(got) == 7
    assert got["precision"]["improvement"] == pytest.approx((0.1 - 0.0001) / 0.0001)
    assert got["recall"]["improvement"] == pytest.approx((0.2 - 0.0001) / 0.0001)
    assert got["mcc"]["improvement"] == pytest.approx(-1.5)
    assert got["mcc"]["direction"] == "increase"
    assert got["false_positive_rate"]["improvement"] == pytest.approx(0.25)
    assert got["false_positive_rate"]["direction"] == "decrease"
    assert got["f1"]["direction"] == "none"


def test_keyword_slices(spark):
    rows = (
        [(0, 1, "five", "t")] * 2 + [(1, 0, "five", "t")] * 3
        + [(0, 1, "four", "t")] * 4
        + [(0, 1, None, "t")] * 9
        + [(1, 0, "positives only", "t")] * 5
    )
    slices = errors.errors_by_keyword(spark.createDataFrame(rows, ROWS), "truth", {"m": "pred"})
    got = {r["keyword"]: r for r in slices.collect()}
    assert set(got) == {"five", "positives only"}
    assert got["five"]["error_rate"] == 1.0
    # counters of another slice never leak into one without negatives
    assert got["positives only"]["false_positive_count"] == 0
    assert got["positives only"]["false_positive_rate"] == 0.0
    nothing = errors.errors_by_keyword(spark.createDataFrame(rows, ROWS), "truth", {"m": "pred"}, min_count=99)
    assert nothing.count() == 0 and "error_rate" in nothing.columns


def test_length_slices_keep_order_and_skip_empty(spark):
    rows = [(0, 1, "k", "x" * n) for n in (1, 80, 81, 700, 1001)] + [(0, 0, "k", None), (0, 0, "k", "")]
    slices = errors.errors_by_length(spark.createDataFrame(rows, ROWS), "truth", {"m": "pred"})
    got = [(r["length_bin"], r["n"]) for r in slices.orderBy("bin_ord").collect()]
    assert got == [("0-80", 2), ("81-120", 1), ("601+", 1)]


def test_all_slices_equal_the_single_ones(spark):
    rows = [(i % 2, (i // 3) % 2, None if i % 7 == 0 else f"k{i % 4}", "x" * (i * 5)) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    every = errors.error_rates_all_slices(df, "truth", {"m": "pred"})
    keyword = errors.errors_by_keyword(df, "truth", {"m": "pred"})
    columns = ["n", "negative_count", "positive_count", "false_positive_count", "false_negative_count", "error_rate"]
    got = every.filter("slice = 'keyword'").select(F.col("slice_value").alias("keyword"), *columns)
    assert sorted(got.collect()) == sorted(keyword.select("keyword", *columns).collect())
    length = errors.errors_by_length(df, "truth", {"m": "pred"})
    got = every.filter("slice = 'length'").select("bin_ord", *columns)
    assert sorted(got.collect()) == sorted(length.select("bin_ord", *columns).collect())
    assert one(every.filter("slice = 'all'"))["n"] == 300


def test_all_slices_read_the_input_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(0, 1, 1, "k", 10, "never read")], "truth int, a int, b int, keyword string, text_length int, note string").write.parquet(path)
    text = plan(errors.error_rates_all_slices(spark.read.parquet(path), "truth", {"A": "a", "B": "b"}))
    assert text.count("FileScan") == 1
    assert "note" not in text
    # only grouped counts are expanded: the expand sits above the first exchange
    assert text.index("Expand") < text.rindex("Exchange")


def test_error_changes(spark):
    rows = [(0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 0, 1), (1, 1, 0), (0, 1, None), (None, 1, 1)]
    df = spark.createDataFrame(rows, "truth int, a int, b int")
    m = one(errors.compare_model_errors(df, "truth", "a", "b"))
    assert (m["fp_fixed"], m["fp_introduced"], m["fp_persistent"]) == (2, 1, 1)
    assert (m["fn_fixed"], m["fn_introduced"], m["fn_persistent"]) == (2, 1, 0)
    assert m["overall_net_improvement"] == 2
    changed = errors.error_change_rows(df, "truth", "a", "b").groupBy("change_class").count().collect()
    assert {r[0]: r[1] for r in changed} == {"fp_fixed": 2, "fp_introduced": 1, "fn_fixed": 2, "fn_introduced": 1}
    long = charts.error_changes_long(errors.compare_model_errors(df, "truth", "a", "b"))
    assert long.count() == 6


def test_sample_is_repeatable_and_capped(spark):
    df = spark.range(5000, numPartitions=8).select(
        F.col("id").alias("post_id"), (F.col("id") % 2 * 0).cast("int").alias("truth"), (F.col("id") % 2 * 0 + 1).cast("int").alias("pred"), F.lit("t").alias("text"), F.lit("k").alias("keyword")
    )
    first = errors.sample_errors(df, "truth", "pred", n=7).collect()
    again = errors.sample_errors(df.repartition(3), "truth", "pred", n=7).collect()
    assert len(first) == 7 and sorted(first) == sorted(again)
    other = errors.sample_errors(df, "truth", "pred", n=7, seed=1).collect()
    assert sorted(first) != sorted(other)
    text = plan(errors.sample_errors(df, "truth", "pred", n=7))
    assert text.count("WindowGroupLimit") == 4


def test_profile_and_counts(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "a", None), (None, None, 1)], "x int, y string, z_Binary int")
    got = {r["column_name"]: r["null_count"] for r in profile.profile(df).collect()}
    assert got == {"x": 1, "y": 2, "z_Binary": 1}
    assert [tuple(r) for r in profile.binary_counts(df).collect()] == [("z_Binary", 1, 2)]
