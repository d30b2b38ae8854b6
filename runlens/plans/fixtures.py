"""Roles of the test tables: posts, answers of two models, a table at volume.

The same views as SQL are in ``*_SQL``, for the checks against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; truth and quality are null where it has no label."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("username"),
        F.col("lang").alias("keyword"),
        "text",
        F.char_length("text").alias("text_length"),
        F.col("toxic").alias("truth"),
        "quality",
    )


POSTS_SQL = """posts AS (
  SELECT d.doc_id AS post_id, d.source AS username, d.lang AS keyword, d.text AS text,
         CAST(length(d.text) AS INTEGER) AS text_length, l.toxic AS truth, l.quality AS quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def answers_a(posts: DataFrame) -> DataFrame:
    """Null, unmarked, marked Yes, and ``unknown``, which reads as No."""
    post = F.col("post_id")
    answer = (
        F.when(post % 11 == 0, F.lit(None).cast("string"))
        .when(post % 7 == 0, F.lit("no markers here, answer is open"))
        .when(F.col("quality") == 0, F.lit("DECISION: Yes\nEXPLANATION:  low quality "))
        .otherwise(F.lit("DECISION: unknown\nEXPLANATION: none"))
    )
    return posts.select(
        "post_id", F.lit("D1").alias("definition"), F.lit("A").alias("model"), answer.alias("answer")
    )


ANSWERS_A_SQL = """answers_a AS (
  SELECT post_id, 'D1' AS definition, 'A' AS model,
         CASE WHEN post_id % 11 = 0 THEN NULL
              WHEN post_id % 7 = 0 THEN 'no markers here, answer is open'
              WHEN quality = 0 THEN concat('DECISION: Yes', chr(10), 'EXPLANATION:  low quality ')
              ELSE concat('DECISION: unknown', chr(10), 'EXPLANATION: none') END AS answer
  FROM posts)"""


def answers_b(posts: DataFrame) -> DataFrame:
    """A third of the posts missing, the others twice; markers reversed or repeated."""
    twice = posts.filter(F.col("post_id") % 3 != 0).select(
        "post_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")
    )
    answer = F.when(
        (F.col("post_id") + F.col("k")) % 2 == 0, F.lit("EXPLANATION: first\nDECISION: YES")
    ).otherwise(F.lit("DECISION: maybe\nEXPLANATION: x EXPLANATION: y"))
    return twice.select(
        "post_id",
        F.lit("D1").alias("definition"),
        F.lit("B").alias("model"),
        (F.col("post_id") * 10 + F.col("k")).alias("ingest_seq"),
        answer.alias("answer"),
    )


ANSWERS_B_SQL = """answers_b AS (
  SELECT post_id, 'D1' AS definition, 'B' AS model, post_id * 10 + k AS ingest_seq,
         CASE WHEN (post_id + k) % 2 = 0
              THEN concat('EXPLANATION: first', chr(10), 'DECISION: YES')
              ELSE concat('DECISION: maybe', chr(10), 'EXPLANATION: x EXPLANATION: y') END AS answer
  FROM posts, (SELECT 1 AS k UNION ALL SELECT 2) t WHERE post_id % 3 <> 0)"""


def parsed_sql(source: str) -> str:
    """Decision and explanation of an answers view, as SQL."""
    part = "split_part(split_part(answer, 'DECISION:', 2), 'EXPLANATION:', 1)"
    marked = "contains(answer, 'DECISION:') AND contains(answer, 'EXPLANATION:')"

    def yes_no(text: str) -> str:
        return (
            f"CASE WHEN contains(lower({text}), 'yes') THEN 'Yes' "
            f"WHEN contains(lower({text}), 'no') THEN 'No' ELSE 'Unclear' END"
        )

    return f"""parsed_{source} AS (
  SELECT *, CASE WHEN answer IS NULL THEN 'Error' WHEN {marked} THEN {yes_no(part)}
                 ELSE {yes_no("substr(lower(answer), 1, 50)")} END AS decision,
            CASE WHEN answer IS NULL THEN 'null response'
                 WHEN {marked} THEN regexp_replace(split_part(answer, 'EXPLANATION:', 2),
                                                   '^\\s+|\\s+$', '', 'g')
                 ELSE answer END AS explanation
  FROM {source})"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume input for metrics and slices: two predictions over every line item."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_linestatus").alias("keyword"),
        ((F.col("l_quantity") - 1) * 25).cast("int").alias("text_length"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("truth"),
        F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("pred_a"),
        F.when(F.col("l_tax") >= 0.04, 1).otherwise(0).alias("pred_b"),
    )


CLASSIFIED_SQL = """classified AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus AS keyword,
         CAST((l_quantity - 1) * 25 AS INTEGER) AS text_length,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth,
         CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS pred_a,
         CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS pred_b
  FROM lineitem)"""


def with_brand(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword from the part table, 25 values."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("_brand")
    )
    return rows.join(part, "l_partkey").withColumn("keyword", F.col("_brand")).drop("_brand")


BRANDED_SQL = """branded AS (
  SELECT c.* REPLACE (p.p_brand AS keyword) FROM classified c JOIN part p ON c.l_partkey = p.p_partkey)"""


def with_sql(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
