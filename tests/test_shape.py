"""Hand cases for row shaping, joins and unions."""

import datetime as dt

from pyspark.sql import functions as F

from runlens.operators import joins, shape


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_length_bin_edges(spark):
    lengths = [None, 0, 1, 80, 81, 1000, 1001]
    df = spark.createDataFrame([(x,) for x in lengths], "n int")
    label, ordinal = shape.length_bin(F.col("n"))
    opened, _ = shape.length_bin(F.col("n"), open_ended=True)
    got = {r["n"]: (r["label"], r["ord"], r["open"]) for r in df.select("n", label.alias("label"), ordinal.alias("ord"), opened.alias("open")).collect()}
    assert got == {
        None: (None, None, None),
        0: (None, None, "0-80"),
        1: ("0-80", 0, "0-80"),
        80: ("0-80", 0, "0-80"),
        81: ("81-120", 1, "81-120"),
        1000: ("601+", 9, "601+"),
        1001: (None, None, "601+"),
    }


def test_to_binary_types(spark):
    text = spark.createDataFrame([("Yes",), ("1",), ("True",), (None,), ("no",)], "v string")
    assert [r["v_Binary"] for r in shape.to_binary(text, "v").collect()] == [1, 1, 0, 0, 0]
    ints = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert [r["v_Binary"] for r in shape.to_binary(ints, "v").collect()] == [1, 0, 0]
    floats = spark.createDataFrame([(1.0,), (0.5,)], "v double")
    assert [r["v_Binary"] for r in shape.to_binary(floats, "v").collect()] == [1, 0]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    assert [r["v_Binary"] for r in shape.to_binary(flags, "v").collect()] == [1, 0, 0]
    assert [r["v_Binary"] for r in shape.to_binary(ints, "v", [2, "x"]).collect()] == [0, 1, 0]
    assert [r["v_Binary"] for r in shape.to_binary(text, "v", ["no", 1]).collect()] == [0, 0, 0, 0, 1]


def test_null_truth_is_no_error(spark):
    df = spark.createDataFrame([(None, 1), (0, None), (0, 1), (1, 0)], "truth int, pred int")
    assert values(shape.error_flags(df, "truth", "pred"), "pred_FP", "pred_FN") == [(0, 0), (0, 0), (0, 1), (1, 0)]
    assert shape.false_positives(df, "truth", "pred").count() == 1
    assert shape.false_negatives(df, "truth", "pred").count() == 1


def test_positions_are_dense_with_one_hot_key(spark):
    # a third of the rows, and most of one partition, share one key
    df = spark.range(3000, numPartitions=6).withColumn(
        "key", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    )
    placed = shape.with_positions(df, "key")
    got = [r["position"] for r in placed.orderBy("position").collect()]
    assert got == list(range(3000))
    keys = [r["key"] for r in placed.orderBy("position").select("key").collect()]
    assert keys == sorted(keys)
    # ties keep the order they came in
    hot = [r["id"] for r in placed.filter("key = 7").orderBy("position").collect()]
    assert hot == sorted(hot)


def test_batches(spark):
    batches = shape.assign_batches(spark.range(250), 100, "id", first_id=1)
    assert values(batches.groupBy("batch_id").count(), "batch_id", "count") == [(1, 100), (2, 100), (3, 50)]
    assert shape.assign_batches(spark.range(0), 100, "id").count() == 0


def test_limit_zero_keeps_all(spark):
    assert shape.limit_rows(spark.range(10), 0, "id").count() == 10
    assert shape.limit_rows(spark.range(10), None, "id").count() == 10
    assert values(shape.limit_rows(spark.range(10), 3, "id"), "id") == [(0,), (1,), (2,)]


def test_stack_aligns_by_name(spark):
    left = spark.createDataFrame([(1, "a")], "x int, y string")
    right = spark.createDataFrame([("b", 2.5)], "y string, z double")
    stacked = shape.stack(left, None, "text", right)
    assert values(stacked, "x", "y", "z") == [(1, "a", None), (None, "b", 2.5)]


def test_compare_runs(spark):
    base = spark.createDataFrame(
        [(1, "one", 1), (2, "two", 0), (2, "again", 1), (3, None, 0)], "post_id long, text string, f int"
    )
    other = spark.createDataFrame(
        [(1, 0, 1), (1, 1, 2), (2, 1, 5), (2, 0, 4), (9, 1, 1)], "post_id long, f int, ingest_seq long"
    )
    side = joins.compare_runs(base, other, ("A", "B"), "post_id", ["post_id", "text"], ["f"])
    assert values(side, "post_id", "text", "text_length", "f_A", "f_B") == sorted(
        [(1, "one", 3, 1, 1), (2, "two", 3, 0, 1), (2, "again", 5, 1, 1), (3, None, None, 0, None)], key=repr
    )


def test_skip_scored_by_age(spark):
    tasks = spark.createDataFrame([(1, "D", "A"), (2, "D", "A"), (3, "D", "A")], "post_id long, definition string, model string")
    now = dt.datetime(2024, 3, 1)
    earlier = spark.createDataFrame(
        [(1, "D", "A", now - dt.timedelta(days=5)), (1, "D", "A", now - dt.timedelta(days=50)),
         (2, "D", "A", now - dt.timedelta(days=31)), (3, "D", "B", now)],
        "post_id long, definition string, model string, scored_at timestamp",
    )
    left = joins.skip_scored(tasks, earlier, F.lit(now), 30)
    assert values(left, "post_id") == [(2,), (3,)]
