"""Queries for metrics, slices, changes, samples, profiles and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.rates import f_beta
from runlens.operators import charts, errors, metrics, profile, shape
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query, round_sql, rounded
from runlens.plans.catalog.shape import (
    AB_SQL,
    C_SQL,
    SIDE_WITH,
    length_case_sql,
    parsed,
    side_by_side,
)

MODELS = {"A": "pred_a", "B": "pred_b"}

# rows once per model, for the SQL side only
LONG_SQL = """long AS (
  SELECT 'A' AS model, keyword, text_length, truth, pred_a AS pred FROM classified
  UNION ALL SELECT 'B', keyword, text_length, truth, pred_b FROM classified)"""
BRANDED_LONG_SQL = LONG_SQL.replace("FROM classified", "FROM branded")

CELLS_SQL = """CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (truth = 0) AS BIGINT) AS negative_count,
       CAST(count(*) FILTER (truth = 1) AS BIGINT) AS positive_count,
       CAST(count(*) FILTER (truth = 0 AND pred = 1) AS BIGINT) AS false_positive_count,
       CAST(count(*) FILTER (truth = 1 AND pred = 0) AS BIGINT) AS false_negative_count"""

SLICE_RATE_SQL = dict(
    false_positive_rate="false_positive_count / nullif(CAST(negative_count AS DOUBLE), 0)",
    false_negative_rate="false_negative_count / nullif(CAST(positive_count AS DOUBLE), 0)",
    error_rate="(false_positive_count + false_negative_count) / nullif(CAST(n AS DOUBLE), 0)",
)
RATES_SQL = round_sql(**SLICE_RATE_SQL)
SLICE_RATES_SQL = round_sql(**SLICE_RATE_SQL, digits=8)

SLICE_COUNTS = ["n", "negative_count", "positive_count", "false_positive_count", "false_negative_count"]
SLICE_RATES = ["false_positive_rate", "false_negative_rate", "error_rate"]

SLICE_METRICS = ["precision", "recall", "f1", "f05", "mcc"]
SLICE_METRICS_SQL = round_sql(
    precision="tp / nullif(tp + fp, 0)",
    recall="tp / nullif(tp + fn, 0)",
    f1="2 * tp / nullif(2 * tp + fn + fp, 0)",
    f05="1.25::DOUBLE * tp / nullif(1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp, 0)",
    mcc="(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)",
    digits=8,
)

METRICS_SQL = (
    """cells AS (
  SELECT model, CAST(count(*) FILTER (truth = 1 AND pred = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (truth = 0 AND pred = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (truth = 0 AND pred = 0) AS DOUBLE) AS tn,
         CAST(count(*) FILTER (truth = 1 AND pred = 0) AS DOUBLE) AS fn, count(*) AS n_rows
  FROM long GROUP BY model),
metrics AS (
  SELECT model, """
    + round_sql(
        accuracy="(tp + tn) / nullif(tp + tn + fp + fn, 0)",
        precision="tp / nullif(tp + fp, 0)",
        recall="tp / nullif(tp + fn, 0)",
        specificity="tn / nullif(tn + fp, 0)",
        f1="2 * tp / nullif(2 * tp + fn + fp, 0)",
        f05="1.25::DOUBLE * tp / nullif(1.25::DOUBLE * tp + 0.25::DOUBLE * fn + fp, 0)",
        mcc="(tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0)",
        balanced_accuracy="(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0))"
        " / nullif(CAST(tp + fn > 0 AS INTEGER) + CAST(tn + fp > 0 AS INTEGER), 0)",
        false_positive_rate="fp / nullif(tn + fp, 0)",
    )
    + """,
         CAST(tp AS BIGINT) AS true_positive, CAST(fp AS BIGINT) AS false_positive,
         CAST(tn AS BIGINT) AS true_negative, CAST(fn AS BIGINT) AS false_negative,
         CAST(tp + fp AS BIGINT) AS total_predicted_positive, CAST(tp + fn AS BIGINT) AS total_actual_positive,
         CAST(tn + fp AS BIGINT) AS total_actual_negative, CAST(tp + fp + tn + fn AS BIGINT) AS total_samples,
         CAST(n_rows - (tp + fp + tn + fn) AS BIGINT) AS n_unscored
  FROM cells)"""
)

DOUBLES = [
    "accuracy", "precision", "recall", "specificity", "f1", "f05", "mcc",
    "balanced_accuracy", "false_positive_rate",
]
COUNTS = [
    "true_positive", "false_positive", "true_negative", "false_negative", "total_predicted_positive",
    "total_actual_positive", "total_actual_negative", "total_samples", "n_unscored",
]

VOLUME_METRICS = fx.with_sql(fx.CLASSIFIED_SQL, LONG_SQL, METRICS_SQL)

SIDE_LONG_SQL = """long AS (
  SELECT 'A' AS model, keyword, text_length, truth, "D1_Binary_A" AS pred FROM side
  UNION ALL SELECT 'B', keyword, text_length, truth, "D1_Binary_B" FROM side)"""


def volume_metrics(spark, d):
    return metrics.classification_metrics(fx.classified(spark, d), "truth", MODELS)


@query(
    "ag01_confusion_counts",
    C_SQL
    + """SELECT count(*) FILTER (truth = 0 AND pred_a = 0) AS tn, count(*) FILTER (truth = 0 AND pred_a = 1) AS fp,
       count(*) FILTER (truth = 1 AND pred_a = 0) AS fn, count(*) FILTER (truth = 1 AND pred_a = 1) AS tp
FROM classified""",
)
def _(spark, d):
    return metrics.confusion_counts(fx.classified(spark, d), "truth", "pred_a")


@query("ag02_classification_metrics", VOLUME_METRICS + "SELECT * FROM metrics")
def _(spark, d):
    return volume_metrics(spark, d).select("model", *rounded(*DOUBLES), *COUNTS)


@query(
    "ag02_metrics_of_two_runs",
    SIDE_WITH.rstrip() + ",\n" + SIDE_LONG_SQL + ",\n" + METRICS_SQL + "\nSELECT * FROM metrics",
)
def _(spark, d):
    models = {"A": "D1_Binary_A", "B": "D1_Binary_B"}
    found = metrics.classification_metrics(side_by_side(spark, d), "truth", models)
    return found.select("model", *rounded(*DOUBLES), *COUNTS)


@query(
    "ag03_fbeta",
    VOLUME_METRICS
    + """SELECT model, f05, round(5.0::DOUBLE * true_positive
       / (5.0::DOUBLE * true_positive + 4.0::DOUBLE * false_negative + false_positive), 10) AS f2 FROM metrics""",
)
def _(spark, d):
    cells = [F.col(c) for c in ("true_positive", "false_positive", "false_negative")]
    return (
        volume_metrics(spark, d)
        .withColumn("f05", f_beta(*cells))
        .withColumn("f2", f_beta(*cells, beta=2.0))
        .select("model", *rounded("f05", "f2"))
    )


@query(
    "ag04_errors_by_length",
    fx.with_sql(
        fx.CLASSIFIED_SQL,
        LONG_SQL,
        f"""slices AS (
  SELECT model, {length_case_sql("text_length")} AS length_bin,
         {length_case_sql("text_length", ordinal=True)} AS bin_ord, {CELLS_SQL}
  FROM long GROUP BY 1, 2, 3)""",
    )
    + f"SELECT model, length_bin, bin_ord, {', '.join(SLICE_COUNTS)}, {RATES_SQL} "
    "FROM slices WHERE bin_ord IS NOT NULL",
)
def _(spark, d):
    slices = errors.errors_by_length(fx.classified(spark, d), "truth", MODELS)
    return slices.select("model", "length_bin", "bin_ord", *SLICE_COUNTS, *rounded(*SLICE_RATES))


BRAND_SLICES = fx.with_sql(
    fx.CLASSIFIED_SQL,
    fx.BRANDED_SQL,
    BRANDED_LONG_SQL,
    f"slices AS (SELECT model, keyword, {CELLS_SQL} FROM long GROUP BY 1, 2 HAVING count(*) >= 5)",
    f"rated AS (SELECT model, keyword, {', '.join(SLICE_COUNTS)}, {RATES_SQL} FROM slices)",
)


def brand_slices(spark, d):
    branded = fx.with_brand(fx.classified(spark, d), spark, d)
    return errors.errors_by_keyword(branded, "truth", MODELS)


@query("ag05_errors_by_keyword", BRAND_SLICES + "SELECT * FROM rated")
def _(spark, d):
    return brand_slices(spark, d).select("model", "keyword", *SLICE_COUNTS, *rounded(*SLICE_RATES))


@query(
    "ag05_post_errors_by_keyword",
    fx.with_sql(
        fx.POSTS_SQL,
        "long AS (SELECT 'rule' AS model, keyword, truth, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS pred FROM posts)",
        f"slices AS (SELECT model, keyword, {CELLS_SQL} FROM long GROUP BY 1, 2 HAVING count(*) >= 5)",
    )
    + f"SELECT model, keyword, {', '.join(SLICE_COUNTS)}, {RATES_SQL} FROM slices",
)
def posts_by_keyword(spark, d):
    """Labelled posts, one rule prediction, error rates by language."""
    predicted = fx.posts(spark, d).withColumn("pred", shape.flag(F.col("quality") == 0))
    slices = errors.errors_by_keyword(predicted, "truth", {"rule": "pred"})
    return slices.select("model", "keyword", *SLICE_COUNTS, *rounded(*SLICE_RATES))


@query(
    "ws02_by_error_rate",
    BRAND_SLICES + "SELECT model, keyword, error_rate FROM rated ORDER BY model, error_rate DESC, keyword",
)
def _(spark, d):
    ordered = errors.by_error_rate(brand_slices(spark, d))
    return ordered.select("model", "keyword", *rounded("error_rate"))


CHANGES_SQL = """SELECT {cols} FROM (
  SELECT count(*) FILTER (a_fp AND NOT b_fp) AS fp_fixed, count(*) FILTER (NOT a_fp AND b_fp) AS fp_introduced,
         count(*) FILTER (a_fp AND b_fp) AS fp_persistent,
         count(*) FILTER (a_fn AND NOT b_fn) AS fn_fixed, count(*) FILTER (NOT a_fn AND b_fn) AS fn_introduced,
         count(*) FILTER (a_fn AND b_fn) AS fn_persistent
  FROM (SELECT truth = 0 AND pred_a = 1 AS a_fp, truth = 0 AND pred_b = 1 AS b_fp,
               truth = 1 AND pred_a = 0 AS a_fn, truth = 1 AND pred_b = 0 AS b_fn FROM classified))"""


@query(
    "ag06_compare_model_errors",
    C_SQL
    + CHANGES_SQL.format(
        cols="*, fp_fixed - fp_introduced AS fp_net_improvement, fn_fixed - fn_introduced AS fn_net_improvement, "
        "fp_fixed - fp_introduced + fn_fixed - fn_introduced AS overall_net_improvement"
    ),
)
def _(spark, d):
    return errors.compare_model_errors(fx.classified(spark, d), "truth", "pred_a", "pred_b")


CHANGE_CLASS_SQL = """CASE WHEN truth = 0 AND {a} = 1 AND coalesce({b}, 0) <> 1 THEN 'fp_fixed'
            WHEN truth = 0 AND coalesce({a}, 0) <> 1 AND {b} = 1 THEN 'fp_introduced'
            WHEN truth = 1 AND {a} = 0 AND coalesce({b}, 1) <> 0 THEN 'fn_fixed'
            WHEN truth = 1 AND coalesce({a}, 1) <> 0 AND {b} = 0 THEN 'fn_introduced' END"""


@query(
    "ag07_error_change_rows",
    SIDE_WITH
    + f"""SELECT * FROM (SELECT post_id, keyword, {CHANGE_CLASS_SQL.format(a='"D1_Binary_A"', b='"D1_Binary_B"')}
       AS change_class FROM side) WHERE change_class IS NOT NULL""",
)
def _(spark, d):
    rows = errors.error_change_rows(side_by_side(spark, d), "truth", "D1_Binary_A", "D1_Binary_B")
    return rows.select("post_id", "keyword", "change_class")


@query(
    "ag08_compare_models",
    VOLUME_METRICS
    + "SELECT model, precision, specificity, false_positive_rate, f05, f1, recall, mcc FROM metrics",
)
def _(spark, d):
    return metrics.compare_models(volume_metrics(spark, d)).select("model", *rounded(*metrics.COMPARED))


def _improvement_sql() -> str:
    rows = []
    for name in metrics.COMPARED:
        sign = "-" if name == metrics.LOWER_IS_BETTER else ""
        floor = f"CASE WHEN abs(a.{name}) < 0.0001 THEN 0.0001::DOUBLE ELSE a.{name} END"
        rows.append(
            f"SELECT '{name}' AS metric, round(a.{name}, 8) AS base_value, round(b.{name}, 8) AS new_value, "
            f"round({sign}((b.{name} - {floor}) / {floor}), 5) AS improvement, "
            f"CASE WHEN b.{name} > a.{name} THEN 'increase' WHEN b.{name} < a.{name} THEN 'decrease' "
            f"ELSE 'none' END AS direction "
            "FROM (SELECT * FROM metrics WHERE model = 'A') a, (SELECT * FROM metrics WHERE model = 'B') b"
        )
    return "\nUNION ALL ".join(rows)


@query("ag09_relative_improvement", VOLUME_METRICS + _improvement_sql())
def _(spark, d):
    change = metrics.relative_improvement(volume_metrics(spark, d), "A", "B")
    return change.select(
        "metric", *rounded("base_value", "new_value", digits=8), *rounded("improvement", digits=5), "direction"
    )


@query(
    "ag10_profile",
    SIDE_WITH
    + "\nUNION ALL ".join(
        f"""SELECT count(*) AS row_count, 7 AS column_count, '{c}' AS column_name, {i} AS ordinal,
       count(*) FILTER ("{c}" IS NULL) AS null_count FROM side"""
        for i, c in enumerate(
            ["post_id", "username", "truth", "keyword", "text_length", "D1_Binary_A", "D1_Binary_B"]
        )
    ),
)
def _(spark, d):
    return profile.profile(side_by_side(spark, d).drop("text"))


@query(
    "ag11_binary_counts",
    C_SQL
    + """SELECT 'pred_a_Binary' AS column_name, pred_a AS value, count(*) AS count FROM classified GROUP BY 2
UNION ALL SELECT 'pred_b_Binary', pred_b, count(*) FROM classified GROUP BY 2""",
)
def _(spark, d):
    rows = fx.classified(spark, d)
    return profile.binary_counts(
        rows.withColumnsRenamed({"pred_a": "pred_a_Binary", "pred_b": "pred_b_Binary"})
    )


@query(
    "ag12_decision_summary",
    AB_SQL
    + """SELECT definition, count(*) FILTER (decision = 'Yes') AS yes_count, count(*) FILTER (decision = 'No') AS no_count,
       count(*) FILTER (decision = 'Error') AS error_count, count(*) FILTER (decision = 'Unclear') AS unclear_count
FROM (SELECT definition || model AS definition, decision FROM parsed_answers_a
      UNION ALL SELECT definition || model, decision FROM parsed_answers_b) GROUP BY definition""",
)
def _(spark, d):
    posts = fx.posts(spark, d)
    both = shape.stack(parsed(fx.answers_a(posts)), parsed(fx.answers_b(posts)))
    return profile.decision_summary(both.withColumn("definition", F.concat("definition", "model")))


@query(
    "ag12_event_summary",
    """SELECT CAST(user_id AS VARCHAR) AS definition,
       count(*) FILTER (event_type = 'click') AS yes_count, count(*) FILTER (event_type = 'view') AS no_count,
       count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS error_count,
       count(*) FILTER (event_type = 'purchase') AS unclear_count
FROM events GROUP BY 1""",
)
def _(spark, d):
    decision = (
        F.when(F.col("event_type") == "click", "Yes")
        .when(F.col("event_type") == "view", "No")
        .when(F.col("event_type") == "purchase", "Unclear")
        .otherwise("Error")
    )
    events = fx.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("definition"), decision.alias("decision")
    )
    return profile.decision_summary(events)


@query(
    "ag13_confusion_table",
    C_SQL
    + """SELECT c.actual, c.predicted, c.count, round(c.count / nullif(CAST(m.count AS DOUBLE), 0) * 100, 8) AS row_percent FROM (
  SELECT CASE WHEN grouping(truth) = 1 THEN 'All' ELSE CAST(truth AS VARCHAR) END AS actual,
         CASE WHEN grouping(pred_a) = 1 THEN 'All' ELSE CAST(pred_a AS VARCHAR) END AS predicted, count(*) AS count
  FROM classified GROUP BY CUBE (truth, pred_a)) c
JOIN (SELECT CASE WHEN grouping(truth) = 1 THEN 'All' ELSE CAST(truth AS VARCHAR) END AS actual, count(*) AS count
      FROM classified GROUP BY GROUPING SETS ((truth), ())) m ON c.actual = m.actual""",
)
def _(spark, d):
    table = metrics.confusion_table(fx.classified(spark, d), "truth", "pred_a")
    return table.select("actual", "predicted", "count", *rounded("row_percent", digits=8))


@query(
    "ag15_error_rates_all_slices",
    fx.with_sql(
        fx.CLASSIFIED_SQL,
        fx.BRANDED_SQL,
        BRANDED_LONG_SQL,
        f"""slices AS (
  SELECT model, bin_ord, keyword, grouping(bin_ord) AS no_bin, grouping(keyword) AS no_keyword, {CELLS_SQL}
  FROM (SELECT *, {length_case_sql("text_length", ordinal=True)} AS bin_ord FROM long)
  GROUP BY GROUPING SETS ((model), (model, bin_ord), (model, keyword)))""",
    )
    + f"""SELECT model, CASE WHEN no_bin = 0 THEN 'length' WHEN no_keyword = 0 THEN 'keyword' ELSE 'all' END AS slice,
       CASE WHEN no_bin = 0 THEN {"CASE bin_ord " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(shape.LENGTH_LABELS)) + " END"}
            ELSE keyword END AS slice_value,
       bin_ord, {', '.join(SLICE_COUNTS)}, {SLICE_RATES_SQL}, {SLICE_METRICS_SQL}
FROM (SELECT *, CAST(positive_count - false_negative_count AS DOUBLE) AS tp, CAST(false_positive_count AS DOUBLE) AS fp,
             CAST(negative_count - false_positive_count AS DOUBLE) AS tn, CAST(false_negative_count AS DOUBLE) AS fn FROM slices)
WHERE (no_bin = 1 AND no_keyword = 1) OR (no_bin = 0 AND bin_ord IS NOT NULL)
   OR (no_keyword = 0 AND keyword IS NOT NULL AND n >= 5)""",
)
def all_slices(spark, d):
    branded = fx.with_brand(fx.classified(spark, d), spark, d)
    slices = errors.error_rates_all_slices(branded, "truth", MODELS)
    return slices.select(
        "model", "slice", "slice_value", "bin_ord", *SLICE_COUNTS, *rounded(*SLICE_RATES, *SLICE_METRICS, digits=8)
    )


TOP_SQL = (
    BRAND_SLICES.rstrip()
    + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {by} DESC, keyword) AS rank
                       FROM rated) WHERE rank <= {n})
"""
)


def top_of(rate: str, columns: str) -> str:
    sql = TOP_SQL.format(by=rate, n=15)
    return f"SELECT * FROM ({sql} SELECT '{rate}' AS by, {columns} FROM top)"


def tops(spark, d, shown):
    found = [
        shown(errors.top_keywords(brand_slices(spark, d), rate), rate).withColumn("by", F.lit(rate))
        for rate in SLICE_RATES
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "ws01_top_keywords",
    "\nUNION ALL ".join(top_of(rate, f"model, keyword, {rate} AS rate, rank") for rate in SLICE_RATES),
)
def _(spark, d):
    return tops(
        spark, d, lambda top, rate: top.select("model", "keyword", F.round(rate, 10).alias("rate"), "rank")
    )


@query(
    "ws03_sample_errors",
    fx.with_sql(fx.POSTS_SQL)
    + """SELECT error_type, post_id, keyword, md5(text) AS text_md5, sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY md5('42-' || post_id), post_id) AS sample_rank
  FROM (SELECT *, CASE WHEN truth = 0 AND quality = 0 THEN 'fp' WHEN truth = 1 AND quality <> 0 THEN 'fn' END AS error_type
        FROM posts) WHERE error_type IS NOT NULL) WHERE sample_rank <= 10""",
)
def _(spark, d):
    predicted = fx.posts(spark, d).withColumn("pred", shape.flag(F.col("quality") == 0))
    return errors.sample_errors(predicted, "truth", "pred").select(
        "error_type", "post_id", "keyword", F.md5("text").alias("text_md5"), "sample_rank"
    )


@query(
    "cd01_metrics_long",
    VOLUME_METRICS
    + "\nUNION ALL ".join(
        f"SELECT model, '{m}' AS metric, {m} AS value FROM metrics" for m in charts.CHARTED_METRICS
    ),
)
def _(spark, d):
    return charts.metrics_long(volume_metrics(spark, d)).select("model", "metric", *rounded("value"))


@query(
    "cd02_length_rates_long",
    fx.with_sql(
        fx.CLASSIFIED_SQL,
        LONG_SQL,
        f"""slices AS (
  SELECT model, {length_case_sql("text_length")} AS length_bin,
         {length_case_sql("text_length", ordinal=True)} AS bin_ord, {CELLS_SQL}
  FROM long GROUP BY 1, 2, 3)""",
        f"rated AS (SELECT *, {RATES_SQL} FROM slices WHERE bin_ord IS NOT NULL)",
    )
    + """SELECT model, length_bin, bin_ord, 'fp' AS error_type, false_positive_rate AS rate FROM rated
UNION ALL SELECT model, length_bin, bin_ord, 'fn', false_negative_rate FROM rated""",
)
def _(spark, d):
    slices = errors.errors_by_length(fx.classified(spark, d), "truth", MODELS)
    return charts.length_rates_long(slices).select(
        "model", "length_bin", "bin_ord", "error_type", *rounded("rate")
    )


LABELS_SQL = {
    "false_positive_rate": "concat(false_positive_count, '/', negative_count)",
    "false_negative_rate": "concat(false_negative_count, '/', positive_count)",
    "error_rate": "concat(false_positive_count, 'FP + ', false_negative_count, 'FN/', n)",
}


@query(
    "cd03_keyword_labels",
    "\nUNION ALL ".join(top_of(rate, f"model, keyword, {rate} AS rate, {LABELS_SQL[rate]} AS label") for rate in SLICE_RATES),
)
def _(spark, d):
    return tops(
        spark,
        d,
        lambda top, rate: charts.keyword_labels(top, rate).select("model", "keyword", *rounded("rate"), "label"),
    )


@query(
    "cd04_error_changes_long",
    C_SQL.rstrip()
    + ",\nchanges AS ("
    + CHANGES_SQL.format(cols="*")
    + ")\n"
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS change, '{k}' AS error_type, {k}_{c} AS count FROM changes"
        for c in errors.CHANGES
        for k in ("fp", "fn")
    ),
)
def _(spark, d):
    changes = errors.compare_model_errors(fx.classified(spark, d), "truth", "pred_a", "pred_b")
    return charts.error_changes_long(changes)
