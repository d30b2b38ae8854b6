"""Queries that write, read back and compare files."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import retrieval
from runlens.operators.shape import assign_batches
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query
from runlens.plans.catalog.shape import AB_SQL, C_SQL, SIDE_WITH, two_runs
from runlens.plans.catalog.metrics import CHANGE_CLASS_SQL
from runlens.plans.comparison import merge_runs
from runlens.sources import batches, index, outputs, tables
from runlens.sources.storage import scratch_path
from runlens.streaming.arrivals import stream_batches, summarise_arrivals


def post_file(posts):
    """Posts under the headers a post file has."""
    return posts.select(
        F.col("post_id").alias("TweetID"),
        F.col("username").alias("Username"),
        F.lit(None).cast("string").alias("CreateDate"),
        F.col("truth").alias("Biased"),
        F.col("keyword").alias("Keyword"),
        F.col("text").alias("Text"),
    )


@query(
    "io01_read_posts",
    fx.with_sql(fx.POSTS_SQL)
    + "SELECT post_id, username, truth, keyword, md5(text) AS text_md5, text_length FROM posts",
)
def _(spark, d):
    path = scratch_path(spark, "posts-csv")
    tables.write_table(post_file(fx.posts(spark, d)), path, "csv")
    return tables.read_posts(spark, path).select(
        "post_id", "username", "truth", "keyword", F.md5("text").alias("text_md5"),
        F.char_length("text").alias("text_length"),
    )


@query(
    "io02_write_table",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'",
)
def _(spark, d):
    path = scratch_path(spark, "orders")
    tables.write_table(fx.table(spark, d, "orders"), path)
    written = spark.read.parquet(path)
    # over its own source
    tables.write_table(written.filter(F.col("o_orderstatus") != "F"), path)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice")


@query(
    "io03_write_batches",
    fx.with_sql(fx.POSTS_SQL)
    + """SELECT batch_id, post_id, md5(text) AS text_md5 FROM (
  SELECT *, CAST((row_number() OVER (ORDER BY post_id) - 1) // 50 + 1 AS INTEGER) AS batch_id FROM posts)""",
)
def _(spark, d):
    path = scratch_path(spark, "batches")
    rows = post_file(fx.posts(spark, d))
    batches.write_batches(assign_batches(rows, 50, "TweetID", first_id=1), path)
    read = batches.read_written_batches(spark, path)
    return read.select("batch_id", "post_id", F.md5("text").alias("text_md5"))


def event_batches(spark, d):
    """Events in the files of three batches, numbered so that text order is wrong."""
    path = scratch_path(spark, "event-batches")
    events = fx.table(spark, d, "events").select(
        F.col("event_id").alias("ID"), F.col("event_type").alias("Keyword"), F.col("props").alias("Text"), "user_id"
    )
    for rest, number in ((0, 2), (1, 10), (2, 1)):
        part = events.filter(F.col("user_id") % 3 == rest)
        tables.write_table(part, f"{path}/batch_{number}.csv", "csv")
    return path


@query(
    "io04_read_batches",
    """SELECT event_id AS post_id, event_type AS keyword, md5(props) AS text_md5,
       CAST(CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 10 ELSE 1 END AS INTEGER) AS batch_id FROM events""",
)
def _(spark, d):
    read = batches.read_batches(spark, event_batches(spark, d))
    return read.select("post_id", "keyword", F.md5("text").alias("text_md5"), "batch_id")


@query(
    "ws06_in_batch_order",
    """SELECT CAST(CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 10 ELSE 1 END AS INTEGER) AS batch_id, event_id AS post_id
FROM events ORDER BY 1, 2""",
)
def _(spark, d):
    read = batches.read_batches(spark, event_batches(spark, d))
    return batches.in_batch_order(read.select("batch_id", "post_id"), "post_id")


@query(
    "io05_read_partials",
    fx.with_sql(fx.POSTS_SQL)
    + "SELECT post_id, keyword, CASE WHEN quality = 0 THEN 'run_7B_part1.csv' ELSE 'run_7B_part2.csv' END AS source_file FROM posts",
)
def _(spark, d):
    path = scratch_path(spark, "partials")
    posts = fx.posts(spark, d)
    tables.write_table(post_file(posts.filter(F.col("quality") == 0)), f"{path}/run_7B_part1.csv", "csv")
    tables.write_table(post_file(posts.filter(~F.col("quality").eqNullSafe(0))), f"{path}/run_7B_part2.csv", "csv")
    for other in ("run_17B_part1.csv", "temp_complete_7B.csv"):
        tables.write_table(post_file(posts), f"{path}/{other}", "csv")
    return batches.read_partials(spark, path, "7B").select("post_id", "keyword", "source_file")


def merged(spark, d):
    a, b = two_runs(spark, d)
    keep = ["post_id", "username", "truth", "keyword", "text"]
    return merge_runs(
        a.select(*keep, F.col("decision").alias("D1_Decision")),
        b.select("post_id", "ingest_seq", F.col("decision").alias("D1_Decision")),
        ("A", "B"),
        ["D1"],
        scratch_path(spark, "comparison"),
        keep,
    )


@query(
    "io06_write_comparison",
    SIDE_WITH
    + """SELECT post_id, username, truth, keyword, text_length, "D1_Binary_A", "D1_Binary_B" FROM side""",
)
def _(spark, d):
    _, side_path = merged(spark, d)
    return spark.read.parquet(side_path).drop("text")


@query(
    "io06_write_stacked",
    AB_SQL
    + """SELECT model, count(*) AS rows, CAST(sum(CASE WHEN decision = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS positives
FROM (SELECT model, decision FROM parsed_answers_a UNION ALL SELECT model, decision FROM parsed_answers_b) GROUP BY model""",
)
def _(spark, d):
    stacked_path, _ = merged(spark, d)
    return spark.read.parquet(stacked_path).groupBy("model").agg(
        F.count("*").alias("rows"), F.sum("D1_Binary").cast("bigint").alias("positives")
    )


@query(
    "io07_write_error_examples",
    C_SQL
    + f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, keyword,
       {CHANGE_CLASS_SQL.format(a="pred_a", b="pred_b")} AS change_class FROM classified) WHERE change_class IS NOT NULL""",
)
def _(spark, d):
    path = scratch_path(spark, "examples")
    outputs.write_error_examples(fx.classified(spark, d), path, "truth", "pred_a", "pred_b")
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "keyword", "change_class")


@query("io08_index_round_trip", "SELECT vec_id, label, vec_id AS nearest FROM embeddings")
def _(spark, d):
    """Write an index, read it from its path alone, and find each vector in it again."""
    path = scratch_path(spark, "index")
    vectors = fx.table(spark, d, "embeddings")
    cells = retrieval.fit_cells(vectors, 8)
    assert index.read_index(spark, path) is None
    index.write_index(retrieval.assign_cells(vectors, cells), path, cells=cells)
    stored = index.read_index(spark, path)
    asked = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.topk_approx(asked, stored.chunks, stored.cells, k=1, n_probe=1)
    nearest = found.select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("nearest"))
    return stored.chunks.select("vec_id", "label").join(nearest, "vec_id")


@query(
    "io04_arriving_batches",
    """SELECT event_type AS definition, count(*) FILTER (value >= 50) AS yes_count,
       count(*) FILTER (value < 50) AS no_count, 0 AS error_count, 0 AS unclear_count FROM events GROUP BY event_type""",
)
def _(spark, d):
    """The events as result files that arrive, summed up as a stream."""
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "arrived-summary")
    decided = fx.table(spark, d, "events").select(
        F.col("event_type").alias("definition"), F.when(F.col("value") >= 50, "Yes").otherwise("No").alias("decision")
    )
    tables.write_table(decided, source)

    def publish(summary, _):
        tables.write_table(summary, target)

    stream = stream_batches(spark, source, decided.schema, "parquet")
    summarise_arrivals(stream, publish, scratch_path(spark, "arrivals-state")).awaitTermination()
    return spark.read.parquet(target)


