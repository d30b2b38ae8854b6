"""Queries for filters, flags, bins, batches, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.text import friendly_name, parse_decision
from runlens.operators import joins, profile, shape
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query


def parsed(answers):
    decision, explanation = parse_decision(F.col("answer"))
    return answers.withColumn("decision", decision).withColumn("explanation", explanation)


A_SQL = fx.with_sql(fx.POSTS_SQL, fx.ANSWERS_A_SQL, fx.parsed_sql("answers_a"))
AB_SQL = fx.with_sql(
    fx.POSTS_SQL,
    fx.ANSWERS_A_SQL,
    fx.ANSWERS_B_SQL,
    fx.parsed_sql("answers_a"),
    fx.parsed_sql("answers_b"),
)
C_SQL = fx.with_sql(fx.CLASSIFIED_SQL)


@query(
    "pf01_filter_eq",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders")
    kept = shape.filter_eq(orders, o_orderstatus="F", o_orderpriority="1-URGENT", no_such_column=1)
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "pf02_limit_rows",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100",
)
def _(spark, d):
    return shape.limit_rows(fx.table(spark, d, "orders"), 100, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    "pf03_assign_batches",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch_id FROM orders",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select("o_orderkey")
    return shape.assign_batches(orders, 500, "o_orderkey").select("o_orderkey", "batch_id")


@query(
    "pf04_to_binary",
    A_SQL
    + """SELECT a.post_id, a.decision, CAST(a.decision = 'Yes' AS INTEGER) AS decision_Binary,
       CAST(coalesce(p.truth = 1, false) AS INTEGER) AS truth_Binary
FROM parsed_answers_a a JOIN posts p ON a.post_id = p.post_id""",
)
def _(spark, d):
    posts = fx.posts(spark, d)
    scored = parsed(fx.answers_a(posts)).join(posts.select("post_id", "truth"), "post_id")
    flagged = shape.to_binary(shape.to_binary(scored, "decision"), "truth")
    same = shape.to_binary(flagged, "no_such_column")
    return same.select("post_id", "decision", "decision_Binary", "truth_Binary")


@query(
    "pf05_decision_flag",
    A_SQL
    + """SELECT post_id, CASE WHEN decision = 'Yes' THEN 1 ELSE 0 END AS flag,
       CASE WHEN answer = 'Yes' THEN 1 ELSE 0 END AS answer_flag FROM parsed_answers_a""",
)
def _(spark, d):
    scored = parsed(fx.answers_a(fx.posts(spark, d)))
    return scored.select(
        "post_id",
        shape.decision_flag(F.col("decision")).alias("flag"),
        shape.decision_flag(F.col("answer")).alias("answer_flag"),
    )


@query(
    "pf06_decision_map",
    AB_SQL
    + """SELECT post_id, model, decision,
       CASE WHEN decision = 'Yes' THEN 1 WHEN decision IN ('No', 'Error', 'Unclear') THEN 0 END AS mapped,
       CASE WHEN answer = 'Yes' THEN 1 WHEN answer IN ('No', 'Error', 'Unclear') THEN 0 END AS mapped_answer
FROM (SELECT post_id, model, decision, answer FROM parsed_answers_a
      UNION ALL SELECT post_id, model, decision, answer FROM parsed_answers_b)""",
)
def _(spark, d):
    posts = fx.posts(spark, d)
    both = shape.stack(parsed(fx.answers_a(posts)), parsed(fx.answers_b(posts)))
    return both.select(
        "post_id",
        "model",
        "decision",
        shape.decision_map(F.col("decision")).alias("mapped"),
        shape.decision_map(F.col("answer")).alias("mapped_answer"),
    )


@query(
    "pf07_add_column",
    """SELECT d.doc_id, d.n_chars, l.quality, d.n_chars * 2 AS doubled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, d):
    documents = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    keyed = shape.add_column(documents, "quality", fx.table(spark, d, "labels"), "doc_id")
    return shape.add_column(keyed, "doubled", F.col("n_chars") * 2)


@query(
    "pf08_project_rename",
    C_SQL
    + """SELECT l_orderkey, l_linenumber, truth, pred_a AS pred_a_7B, pred_b AS pred_b_7B FROM classified""",
)
def _(spark, d):
    return shape.project_rename(
        fx.classified(spark, d), ["l_orderkey", "l_linenumber", "truth"], ["pred_a", "pred_b"], "7B"
    )


@query("pf09_text_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def _(spark, d):
    return shape.with_text_length(fx.table(spark, d, "documents")).select("doc_id", "text_length")


@query(
    "pf10_false_positives",
    C_SQL + "SELECT l_orderkey, l_linenumber, keyword, text_length FROM classified WHERE truth = 0 AND pred_a = 1",
)
def _(spark, d):
    rows = shape.false_positives(fx.classified(spark, d), "truth", "pred_a")
    return rows.select("l_orderkey", "l_linenumber", "keyword", "text_length")


@query(
    "pf11_false_negatives",
    C_SQL + "SELECT l_orderkey, l_linenumber, keyword, text_length FROM classified WHERE truth = 1 AND pred_a = 0",
)
def _(spark, d):
    rows = shape.false_negatives(fx.classified(spark, d), "truth", "pred_a")
    return rows.select("l_orderkey", "l_linenumber", "keyword", "text_length")


@query(
    "pf12_error_flags",
    C_SQL
    + """SELECT l_orderkey, l_linenumber,
       CAST(truth = 0 AND pred_a = 1 AS INTEGER) AS "pred_a_FP", CAST(truth = 1 AND pred_a = 0 AS INTEGER) AS "pred_a_FN",
       CAST(truth = 0 AND pred_b = 1 AS INTEGER) AS "pred_b_FP", CAST(truth = 1 AND pred_b = 0 AS INTEGER) AS "pred_b_FN"
FROM classified""",
)
def _(spark, d):
    flagged = shape.error_flags(fx.classified(spark, d), "truth", "pred_a", "pred_b")
    return flagged.select(
        "l_orderkey", "l_linenumber", "pred_a_FP", "pred_a_FN", "pred_b_FP", "pred_b_FN"
    )


def length_case_sql(length: str, ordinal: bool = False, open_ended: bool = False) -> str:
    cases = []
    last = len(shape.LENGTH_LABELS) - 1
    for i, label in enumerate(shape.LENGTH_LABELS):
        low, high = shape.LENGTH_EDGES[i], shape.LENGTH_EDGES[i + 1]
        value = str(i) if ordinal else f"'{label}'"
        above = f"{length} >= {low}" if open_ended and i == 0 else f"{length} > {low}"
        below = "" if open_ended and i == last else f" AND {length} <= {high}"
        cases.append(f"WHEN {above}{below} THEN {value}")
    return "CASE " + " ".join(cases) + " END"


@query(
    "pf13_length_bin",
    C_SQL
    + f"""SELECT l_orderkey, l_linenumber, {length_case_sql("text_length")} AS length_bin,
       {length_case_sql("text_length", ordinal=True)} AS bin_ord,
       {length_case_sql("text_length", open_ended=True)} AS open_bin FROM classified""",
)
def _(spark, d):
    label, ordinal = shape.length_bin(F.col("text_length"))
    open_label, _ = shape.length_bin(F.col("text_length"), open_ended=True)
    return fx.classified(spark, d).select(
        "l_orderkey",
        "l_linenumber",
        label.alias("length_bin"),
        ordinal.alias("bin_ord"),
        open_label.alias("open_bin"),
    )


@query(
    "pf14_friendly_name",
    C_SQL
    + """SELECT model, CAST(count(*) AS BIGINT) AS rows, CAST(sum(v) AS BIGINT) AS positives FROM (
  SELECT 'pred_a' AS model, pred_a AS v FROM classified UNION ALL SELECT 'pred_b', pred_b FROM classified)
GROUP BY model""",
)
def _(spark, d):
    flags = fx.classified(spark, d).select(
        F.col("pred_a").alias("pred_a_Binary"), F.col("pred_b").alias("pred_b_Binary")
    )
    counted = profile.binary_counts(flags)
    return counted.groupBy(friendly_name(F.col("column_name")).alias("model")).agg(
        F.sum("count").alias("rows"), F.sum(F.col("count") * F.col("value")).alias("positives")
    )


def two_runs(spark, d):
    """Both runs of the posts with a D1 flag; run B has repeated posts."""
    posts = fx.posts(spark, d)
    a = posts.join(parsed(fx.answers_a(posts)), "post_id")
    b = parsed(fx.answers_b(posts))
    flag = {"D1_Binary": shape.decision_flag(F.col("decision"))}
    return a.withColumns(flag), b.withColumns(flag)


def side_by_side(spark, d):
    a, b = two_runs(spark, d)
    carry = ["post_id", "username", "truth", "keyword", "text"]
    return joins.compare_runs(a, b, ("A", "B"), "post_id", carry, ["D1_Binary"])


SIDE_SQL = """side AS (
  SELECT p.post_id, p.username, p.truth, p.keyword, p.text, p.text_length,
         CASE WHEN a.decision = 'Yes' THEN 1 ELSE 0 END AS "D1_Binary_A", b.flag AS "D1_Binary_B"
  FROM posts p JOIN parsed_answers_a a ON p.post_id = a.post_id
  LEFT JOIN (SELECT post_id, max_by(CASE WHEN decision = 'Yes' THEN 1 ELSE 0 END, ingest_seq) AS flag
             FROM parsed_answers_b GROUP BY post_id) b ON p.post_id = b.post_id)"""

SIDE_WITH = AB_SQL.rstrip() + ",\n" + SIDE_SQL + "\n"


@query(
    "jn01_compare_runs",
    SIDE_WITH
    + """SELECT post_id, username, truth, keyword, text_length, "D1_Binary_A", "D1_Binary_B" FROM side""",
)
def _(spark, d):
    return side_by_side(spark, d).drop("text")


@query(
    "jn05_skip_scored",
    """SELECT c_custkey AS post_id, c_mktsegment AS definition FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
                  AND o_orderdate > TIMESTAMP '2001-08-01' - INTERVAL 365 DAY)""",
)
def _(spark, d):
    tasks = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("post_id"), F.col("c_mktsegment").alias("definition")
    )
    previous = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("post_id"), F.col("o_orderdate").alias("scored_at")
    )
    now = F.lit("2001-08-01").cast("timestamp")
    return joins.skip_scored(tasks, previous, now, 365, keys=["post_id"])


@query(
    "so01_stack",
    """SELECT o_orderkey AS id, 'order' AS kind, o_totalprice AS amount, NULL AS segment FROM orders
UNION ALL SELECT c_custkey, 'customer', NULL, c_mktsegment FROM customer""",
)
def _(spark, d):
    orders = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount")
    )
    customers = fx.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")
    )
    return shape.stack(orders, "not a table", customers)


@query(
    "so02_stack_runs",
    AB_SQL
    + """SELECT post_id, 'A' AS model, decision, CASE WHEN decision = 'Yes' THEN 1 ELSE 0 END AS "D1_Binary",
       NULL AS ingest_seq FROM parsed_answers_a
UNION ALL SELECT post_id, 'B', decision, CASE WHEN decision = 'Yes' THEN 1 ELSE 0 END, ingest_seq
FROM parsed_answers_b""",
)
def _(spark, d):
    posts = fx.posts(spark, d)
    runs = {"A": parsed(fx.answers_a(posts)), "B": parsed(fx.answers_b(posts))}
    return shape.stack_runs(runs, {"D1_Binary": "decision"}).select(
        "post_id", "model", "decision", "D1_Binary", "ingest_seq"
    )


@query(
    "so03_drop_identical_results",
    "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem",
)
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus")
    return shape.drop_identical_results(rows)
