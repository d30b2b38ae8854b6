"""Files: quoting, batch order, partial results, overwriting, index."""

import csv
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators.retrieval import Cells
from runlens.sources import batches, index, storage, tables


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


POSTS = [
    (1, "u", "2024", 1, "k", 'multi\nline, with "quotes"'),
    (2, "v", "", 0, "", " spaces kept "),
    (3, "w", "2024", "", "k", "backslash \\ and \\\" end"),
]


@pytest.mark.parametrize("id_name", ["TweetID", "ID"])
def test_read_posts(spark, tmp_path, id_name):
    path = str(tmp_path / "posts.csv")
    write_csv(path, [id_name, "Username", "CreateDate", "Biased", "Keyword", "Text"], POSTS)
    got = tables.read_posts(spark, path).orderBy("post_id").collect()
    assert [r["text"] for r in got] == [p[5] for p in POSTS]
    assert [r["truth"] for r in got] == [1, 0, None]
    assert [r["post_id"] for r in got] == [1, 2, 3]
    assert got[1]["keyword"] is None
    as_text = tables.read_posts(spark, path, id_type="string")
    assert dict(as_text.dtypes)["post_id"] == "string"


def test_csv_round_trip(spark, tmp_path):
    path, out = str(tmp_path / "in.csv"), str(tmp_path / "out")
    write_csv(path, ["ID", "Text"], [(i, t) for i, (*_, t) in enumerate(POSTS)])
    posts = tables.read_posts(spark, path)
    tables.write_table(posts, out, "csv")
    assert sorted(tables.read_posts(spark, out).collect()) == sorted(posts.collect())


def test_overwrite_own_source(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(10), path)
    tables.write_table(spark.read.parquet(path).filter("id > 5"), path)
    assert spark.read.parquet(path).count() == 4
    tables.write_table(spark.read.parquet(path).filter("id > 7"))
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="source path"):
        tables.write_table(spark.range(3))
    # a sibling whose name only starts the same is another table
    tables.write_table(spark.read.parquet(path), str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 2


def test_partitioned_output_has_few_files(spark, tmp_path):
    rows = spark.range(4000, numPartitions=16).withColumn("kind", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold"))
    tables.write_table(rows, str(tmp_path / "t"), partition_by=["kind"])
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("kind").count().count() == 2
    files = [f for f in (tmp_path / "t").rglob("part-*")]
    assert 2 <= len(files) < 16


def test_rows_of_one_file_are_spread(spark, tmp_path):
    path = str(tmp_path / "posts.csv")
    write_csv(path, ["TweetID", "Text"], [(i, "t") for i in range(100)])
    spread = tables.read_posts(spark, path, partitions=4)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 100


def test_batches_in_numeric_order_last_wins(spark, tmp_path):
    for n, flag in ((1, "No"), (2, "No"), (10, "Yes")):
        write_csv(tmp_path / f"batch_{n}.csv", ["TweetID", "D_Decision"], [(7, flag), (n * 100, "No"), (8, f"row of {n}")])
    write_csv(tmp_path / "other.csv", ["TweetID", "D_Decision"], [(1, "x")])
    read = batches.read_batches(spark, str(tmp_path))
    assert [r[0] for r in read.select("batch_id").distinct().orderBy("batch_id").collect()] == [1, 2, 10]
    last = read.groupBy("post_id").agg(F.max_by("D_Decision", "ingest_seq").alias("d"))
    got = {r["post_id"]: r["d"] for r in last.collect()}
    assert got[7] == "Yes" and got[8] == "row of 10" and 1 not in got
    ordered = batches.in_batch_order(read, "ingest_seq").collect()
    assert [r["post_id"] for r in ordered] == [7, 100, 8, 7, 200, 8, 7, 1000, 8]


def test_batches_with_different_headers_align_by_name(spark, tmp_path):
    write_csv(tmp_path / "batch_1.csv", ["TweetID", "Text"], [(1, "a\nb"), (2, "c")])
    write_csv(tmp_path / "batch_2.csv", ["Text", "TweetID", "Keyword"], [("d", 3, "k")])
    (tmp_path / "batch_3.csv").write_text("")
    read = batches.read_batches(spark, str(tmp_path))
    got = sorted((r["post_id"], r["text"], r["keyword"], r["batch_id"]) for r in read.collect())
    assert got == [(1, "a\nb", None, 1), (2, "c", None, 1), (3, "d", "k", 2)]


def test_sequence_is_unique_over_part_files(spark, tmp_path):
    rows = spark.range(1000, numPartitions=8).select(F.col("id").alias("TweetID"), F.lit("x").alias("Text"))
    for n in (3, 12):
        tables.write_table(rows, str(tmp_path / f"batch_{n}.csv"), "csv")
    read = batches.read_batches(spark, str(tmp_path))
    assert read.count() == 2000 and read.select("ingest_seq").distinct().count() == 2000
    ordered = [r["post_id"] for r in read.orderBy("ingest_seq").collect()]
    assert ordered == list(range(1000)) * 2


def test_no_batches_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no batch files"):
        batches.read_batches(spark, str(tmp_path))


def test_written_batches_survive_a_partial_run(spark, tmp_path):
    path = str(tmp_path / "b")
    first = spark.range(4).select(F.col("id").alias("post_id"), (F.col("id") % 2).alias("batch_id"))
    batches.write_batches(first, path)
    batches.write_batches(first.filter("batch_id = 1").withColumn("post_id", F.col("post_id") + 10), path)
    got = sorted((r["batch_id"], r["post_id"]) for r in batches.read_written_batches(spark, path).collect())
    assert got == [(0, 0), (0, 2), (1, 11), (1, 13)]


def test_partials_match_whole_model_names(spark, tmp_path):
    for name in ("r_7B_1.csv", "r_17B_1.csv", "7B.csv", "temp_complete_7B.csv", "x7Bx.csv"):
        write_csv(tmp_path / name, ["TweetID", "Text"], [(1, name)])
    read = batches.read_partials(spark, str(tmp_path), "7B")
    assert sorted(r["source_file"] for r in read.collect()) == ["7B.csv", "r_7B_1.csv"]
    with pytest.raises(ValueError):
        batches.read_partials(spark, str(tmp_path), "8B")
    with pytest.raises(ValueError):
        batches.read_partials(spark, str(tmp_path), "x7")


def test_index_missing_then_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.read_index(spark, path) is None
    cells = Cells(np.array([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]))
    index.write_index(spark.range(3).withColumn("cell", F.lit(1)), path, cells=cells)
    index.write_index(spark.range(2).withColumn("cell", F.lit(2)), path, cells=cells)
    found = index.read_index(spark, path)
    assert found.chunks.count() == 2 and found.embedder is None
    assert found.cells.centres.tolist() == cells.centres.tolist()


def test_bounded_rows(spark):
    assert len(storage.bounded_rows(spark.range(5), 5, "rows")) == 5
    with pytest.raises(ValueError, match="more than 4"):
        storage.bounded_rows(spark.range(5), 4, "rows")


def test_scratch_is_under_the_shared_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert configured is None or folder == configured.rstrip("/")
    assert storage.scratch_path(spark, "x").startswith(folder)


def test_clean_scratch(spark):
    kept = storage.materialize(spark.range(3), "x")
    assert kept.count() == 3
    storage.clean_scratch(spark)
    own = f"{storage.shared_folder(spark)}/runlens/{spark.sparkContext.applicationId}"
    assert not os.path.exists(own.removeprefix("file:"))


def test_any_number_of_layouts(spark, tmp_path):
    for i in range(70):
        (tmp_path / f"batch_{i + 1}.csv").write_text(f"ID,Text,extra{i}\n{i},text {i},{i * 10}\n")
    got = batches.read_batches(spark, str(tmp_path))
    assert got.count() == 70
    assert [r["batch_id"] for r in got.filter("extra69 IS NOT NULL").collect()] == [70]
