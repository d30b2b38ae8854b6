"""Queries for topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import topics
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query
from runlens.plans.catalog.text import STOP_WORDS, TOKENS_SQL

K = 5
ITERATIONS = 10  # enough for stable invariants; callers choose their own


def false_positive_topics(spark, d):
    # every labelled post predicted positive: all posts without the label are errors
    predicted = fx.posts(spark, d).withColumn("pred", F.lit(1))
    return topics.fp_topics(predicted, "truth", "pred", k=K, max_iter=ITERATIONS)


POST_TERMS_SQL = fx.with_sql(
    fx.POSTS_SQL,
    f"tokens AS (SELECT post_id, {TOKENS_SQL} AS tokens FROM posts)",
    "words AS (SELECT post_id, unnest(tokens) AS term FROM tokens)",
    """vocabulary AS (SELECT term FROM words GROUP BY term HAVING count(DISTINCT post_id) >= 2
       AND count(DISTINCT post_id) <= 0.95::DOUBLE * (SELECT count(*) FROM posts))""",
)


def post_tokens(spark, d):
    return topics.tokenize(fx.posts(spark, d).select("post_id", "text"), stop_words=STOP_WORDS)


@query(
    "tm01_term_counts",
    POST_TERMS_SQL + "SELECT post_id, term, count(*) AS count FROM words JOIN vocabulary USING (term) GROUP BY post_id, term",
)
def _(spark, d):
    return topics.term_counts(post_tokens(spark, d), "post_id")


# what the sparse rows add up to
@query(
    "tm01_term_matrix",
    POST_TERMS_SQL
    + """SELECT post_id, CAST(count(DISTINCT v.term) AS INTEGER) AS n_terms, CAST(count(v.term) AS BIGINT) AS n_words
FROM posts LEFT JOIN words USING (post_id) LEFT JOIN vocabulary v USING (term) GROUP BY post_id""",
)
def _(spark, d):
    matrix, _ = topics.term_matrix(post_tokens(spark, d))
    return topics.term_totals(matrix).select("post_id", "n_terms", "n_words")


# A fitted model has no answer in SQL; what must hold of any fit is compared.
FALSE_POSITIVES = fx.with_sql(fx.POSTS_SQL, "fp AS (SELECT post_id FROM posts WHERE truth = 0)")


@query(
    "tm02_tm04_assigned_topics",
    FALSE_POSITIVES + "SELECT post_id, true AS in_range, true AS adds_up, true AS is_largest FROM fp",
)
def _(spark, d):
    share = F.col("topic_distribution")
    total = F.aggregate(share, F.lit(0.0), lambda a, b: a + b)
    return false_positive_topics(spark, d).assigned.select(
        "post_id",
        F.col("topic_id").between(0, K - 1).alias("in_range"),
        (F.abs(total - 1) < 1e-6).alias("adds_up"),
        (F.get(share, F.col("topic_id")) == F.array_max(share)).alias("is_largest"),
    )


@query(
    "tm03_ws05_top_terms",
    f"""SELECT CAST(t.i AS INTEGER) AS topic_id, CAST(10 AS BIGINT) AS n_terms, true AS descending, true AS different
FROM range({K}) t(i)""",
)
def _(spark, d):
    by_topic = false_positive_topics(spark, d).terms.groupBy("topic_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term_prob"))).alias("ranked"),
        F.countDistinct("term").alias("n_different"),
    )
    weights = F.transform("ranked", lambda r: r["term_prob"])
    return by_topic.select(
        "topic_id",
        F.size("ranked").cast("long").alias("n_terms"),
        (F.sort_array(weights, asc=False) == weights).alias("descending"),
        (F.col("n_different") == F.size("ranked")).alias("different"),
    )


@query(
    "tm05_fp_topic_counts",
    FALSE_POSITIVES + f"SELECT {K} AS n_topics, count(*) AS n_posts, true AS shares_add_up FROM fp",
)
def _(spark, d):
    return false_positive_topics(spark, d).counts.agg(
        F.count("*").cast("int").alias("n_topics"),
        F.sum("count").alias("n_posts"),
        (F.abs(F.sum("share") - 1) < 1e-9).alias("shares_add_up"),
    )


@query(
    "tm06_topic_report",
    FALSE_POSITIVES + f"""SELECT CAST(t.i + 1 AS INTEGER) AS topic, CAST(10 AS BIGINT) AS n_terms, true AS examples_fit,
       true AS in_order FROM range({K}) t(i)""",
)
def _(spark, d):
    """Ten terms, and five examples or as many as the topic has, numbered from one."""
    report = topics.topic_report(false_positive_topics(spark, d))
    term, example = F.col("section") == "term", F.col("section") == "example"
    return report.groupBy("topic", "count").agg(
        F.count_if(term).alias("n_terms"),
        F.count_if(example).alias("_examples"),
        (F.max(F.when(term, F.col("position"))) == F.count_if(term)).alias("in_order"),
    ).select("topic", "n_terms", (F.col("_examples") == F.least("count", F.lit(5))).alias("examples_fit"), "in_order")


@query(
    "tx14_topic_label",
    f"SELECT CAST(t.i AS INTEGER) AS topic_id, true AS named, true AS three_terms FROM range({K}) t(i)",
)
def _(spark, d):
    found = false_positive_topics(spark, d)
    label = topics.topic_label(found.terms, found.counts)
    lead = found.terms.filter("rank <= 3").groupBy("topic_id").agg(F.collect_set("term").alias("lead"))
    words = F.split(F.regexp_replace("label", "^Topic [0-9]+: ", ""), " ")
    return label.join(lead, "topic_id").select(
        "topic_id",
        F.col("label").startswith(F.concat(F.lit("Topic "), (F.col("topic_id") + 1).cast("string"), F.lit(": "))).alias("named"),
        (F.sort_array(words) == F.sort_array("lead")).alias("three_terms"),
    )


# the classes of the embeddings stand in for topics, so counts have an answer in SQL
@query(
    "ag14_topic_counts",
    """SELECT CAST(t.topic_id AS INTEGER) AS topic_id, count(e.vec_id) AS count,
       round(count(e.vec_id) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 10) AS share
FROM range(12) t(topic_id) LEFT JOIN embeddings e ON e.label = t.topic_id GROUP BY t.topic_id""",
)
def _(spark, d):
    assigned = fx.table(spark, d, "embeddings").select(F.col("label").alias("topic_id"))
    counts = topics.topic_counts(assigned, 12)
    return counts.select("topic_id", "count", F.round("share", 10).alias("share"))


@query(
    "ws04_sample_per_topic",
    fx.with_sql(fx.POSTS_SQL)
    + """SELECT topic_id, post_id, md5(text) AS text_md5, sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY md5('42-' || post_id), post_id) AS sample_rank
  FROM (SELECT *, 2 * coalesce(quality, 0) + coalesce(truth, 0) AS topic_id FROM posts)) WHERE sample_rank <= 5""",
)
def _(spark, d):
    assigned = fx.posts(spark, d).withColumn("topic_id", 2 * F.coalesce("quality", F.lit(0)) + F.coalesce("truth", F.lit(0)))
    return topics.sample_per_topic(assigned).select(
        "topic_id", "post_id", F.md5("text").alias("text_md5"), "sample_rank"
    )
