"""Whole flows: merge and analyse, build an index and score with context, arriving files."""

import os

from pyspark.sql import functions as F

from runlens.operators.scoring import score_rule
from runlens.plans.comparison import analyse_runs, merge_runs
from runlens.plans.context_index import build_index
from runlens.sources.index import read_index
from runlens.plans.inference import score_with_context
from runlens.sources import tables
from runlens.sources.outputs import write_error_examples
from runlens.streaming.arrivals import stream_batches, summarise_arrivals

POST = "post_id long, username string, create_date string, truth int, keyword string, text string"


def posts(spark, n=40):
    topics = ["red green blue colour paint", "bread milk egg flour butter"]
    return spark.createDataFrame(
        [(i, f"u{i}", "2024", i % 2, f"k{i % 3}", f"{topics[i // 2 % 2]} number{i} http://a.b/{i}") for i in range(n)], POST
    )


def run(spark, rule, twice=False):
    decided = posts(spark).withColumn("D_Decision", rule)
    first = decided.withColumn("ingest_seq", F.col("post_id") * 10)
    if not twice:
        return first
    stale = first.withColumn("D_Decision", F.lit("Unclear")).withColumn("ingest_seq", F.col("ingest_seq") - 5)
    return first.unionByName(stale)


def test_merge_and_analyse(spark, tmp_path):
    base = run(spark, F.lit("Yes"))
    new = run(spark, F.when(F.col("truth") == 1, "Yes").otherwise("No"), twice=True)
    carry = ["post_id", "truth", "keyword", "text"]
    for fmt in ("parquet", "csv"):
        stacked_path, side_path = merge_runs(base, new, ("7B", "8B"), ["D"], str(tmp_path / fmt), carry, fmt=fmt)
        assert os.path.basename(side_path) == "comparative_model_results_7B_vs_8B"
        read = spark.read.parquet(side_path) if fmt == "parquet" else tables.read_posts(spark, side_path)
        assert read.count() == 40
        assert read.filter("D_Binary_8B = truth").count() == 40
    side = spark.read.parquet(str(tmp_path / "parquet" / "comparative_model_results_7B_vs_8B"))
    report = analyse_runs(side, "truth", "D_Binary_7B", "D_Binary_8B", topics=True, k=2, max_iter=5)
    metrics = {r["model"]: r for r in report.metrics.collect()}
    assert metrics["D_8B"]["accuracy"] == 1.0 and metrics["D_7B"]["accuracy"] == 0.5
    assert report.error_changes.collect()[0]["fp_fixed"] == 20
    assert report.changed_rows.count() == 20
    assert report.slices.filter("slice = 'keyword'").count() == 6
    assert {r["metric"]: r["improvement"] for r in report.improvement.collect()}["precision"] == 1.0
    assert report.topics["D_8B"].counts.count() == 0
    assert sum(r["count"] for r in report.topics["D_7B"].counts.collect()) == 20
    write_error_examples(side, str(tmp_path / "ex"), "truth", "D_Binary_7B", "D_Binary_8B")
    assert [f for f in os.listdir(tmp_path / "ex") if f.startswith("change")] == ["change_class=fp_fixed"]


def test_context_flow(spark, tmp_path):
    table = posts(spark)
    definitions = spark.createDataFrame(
        [("D", "plain {text}", "Read: {text} by {definition_text}")], "definition string, template string, context_template string"
    )
    build_index(table, str(tmp_path / "index"), n_cells=4)
    index = read_index(spark, str(tmp_path / "index"))
    chunks = index.chunks
    assert chunks.count() == 40 and chunks.select("vec_id").distinct().count() == 40
    assert len(index.cells.centres) == 4
    row = chunks.filter("post_id = 3").collect()[0]
    assert row["chunk"].endswith("- http://a.b/3\n") and row["metadata"]["keyword"] == "k0"
    assert list((tmp_path / "index").glob("data-*/chunks/cell=*"))

    # the answer tells whether the nearest context, that of the post itself, came first
    answer = F.when(
        F.contains(F.substring("prompt", 1, 40), F.regexp_extract("text", "^[a-z]+ [a-z]+", 0)), "DECISION: yes"
    ).otherwise("Decision: no")
    seen = score_with_context(table, definitions, index, lambda t: score_rule(t, answer))
    assert {(r["D_Decision"], r["D_Binary"]) for r in seen.wide.collect()} == {("Yes", 1)}
    assert set(seen.results.select("mode").distinct().toPandas()["mode"]) == {"context"}

    exact = score_with_context(table, definitions, index, lambda t: score_rule(t, answer), n_probe=None)
    assert {r["D_Decision"] for r in exact.wide.collect()} == {"Yes"}

    plain = score_with_context(table, definitions, None, lambda t: score_rule(t, F.col("prompt")))
    assert plain.wide.count() == 40
    assert plain.results.filter("explanation not like 'plain %'").count() == 0


def test_context_flow_loses_no_neighbour(spark, tmp_path):
    table = posts(spark, n=120)
    definitions = spark.createDataFrame(
        [("D", "plain {text}", "Read: {text} by {definition_text}")], "definition string, template string, context_template string"
    )
    index = build_index(table, str(tmp_path / "index"), n_cells=60)

    def prompts(**options):
        seen = score_with_context(table, definitions, index, lambda t: score_rule(t, F.col("prompt")), **options)
        return {r["post_id"]: r["explanation"] for r in seen.results.collect()}

    exact = prompts(n_probe=None)
    assert len(exact) == 120 and prompts() == exact
    assert prompts(share=1.0) == exact
    assert prompts(n_probe=8) != exact  # with more cells fixed probes lose neighbours


def test_arriving_files_add_up(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = spark.createDataFrame([("D", "Yes"), ("D", "No"), ("E", "Error")], "definition string, decision string")
    seen = []

    def publish(summary, _):
        seen.append({r["definition"]: r["yes_count"] + r["no_count"] + r["error_count"] for r in summary.collect()})

    for _ in range(2):
        rows.coalesce(1).write.mode("append").options(header=True).csv(folder)
        summarise_arrivals(stream_batches(spark, folder, rows.schema), publish, state).awaitTermination()
    assert seen == [{"D": 2, "E": 1}, {"D": 4, "E": 2}]
