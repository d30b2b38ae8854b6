"""Queries for scoring: rules, models, callables, failures and fallbacks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from runlens.operators import prompts, scoring, topics
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query
from runlens.plans.catalog.text import DEFINITIONS_SQL, two_definitions
from runlens.plans.inference import score_posts
from runlens.sources.storage import scratch_path

TASKS_SQL = fx.with_sql(
    fx.POSTS_SQL,
    DEFINITIONS_SQL,
    "tasks AS (SELECT post_id, keyword, truth, quality, text, definition, "
    "replace(template, '{text}', text) AS prompt FROM posts, definitions)",
)


def tasks(spark, d):
    built = prompts.build_tasks(fx.posts(spark, d), two_definitions(spark, d))
    return prompts.render_prompts(built).select(
        "post_id", "keyword", "truth", "quality", "text", "definition", "prompt"
    )


# the rule used as a stand-in for a model: it reads the whole prompt
ANSWER_SQL = """'DECISION: ' || CASE WHEN length(prompt) % 2 = 0 THEN 'Yes' ELSE 'No' END
       || chr(10) || 'EXPLANATION: ' || length(prompt) || ' characters'"""


def rule_answer():
    length = F.char_length("prompt")
    return F.concat(
        F.lit("DECISION: "),
        F.when(length % 2 == 0, "Yes").otherwise("No"),
        F.lit("\nEXPLANATION: "),
        length.cast("string"),
        F.lit(" characters"),
    )


def make_scorer():
    """The same rule as a callable, failing like the fault rule."""

    def score(prompt: str) -> str:
        if len(prompt) % 4 == 0:
            raise ValueError("injected fault")
        decision = "Yes" if len(prompt) % 2 == 0 else "No"
        return f"DECISION: {decision}\nEXPLANATION: {len(prompt)} characters"

    return score


def make_flaky_scorer():
    """Fails the first time it sees a prompt whose length divides by four."""
    waiting = set()

    def score(prompt: str) -> str:
        if len(prompt) % 4 == 0 and prompt not in waiting:
            waiting.add(prompt)
            raise ValueError("injected fault")
        waiting.discard(prompt)
        return f"DECISION: No\nEXPLANATION: {len(prompt)} characters"

    return score


def fault():
    return F.when(F.char_length("prompt") % 4 == 0, F.lit("injected fault"))


PARSED_SQL = """CASE WHEN length(prompt) % 4 = 0 THEN 'Error' WHEN length(prompt) % 2 = 0 THEN 'Yes' ELSE 'No' END AS decision,
       CASE WHEN length(prompt) % 4 = 0 THEN 'injected fault' ELSE length(prompt) || ' characters' END AS explanation"""


@query(
    "sc01_score_rule",
    TASKS_SQL + f"SELECT post_id, definition, {ANSWER_SQL} AS answer, 'ok' AS status FROM tasks",
)
def _(spark, d):
    scored = scoring.score_rule(tasks(spark, d), rule_answer())
    return scored.select("post_id", "definition", "answer", "status")


# fitted on the labelled posts, applied to all of them
@query(
    "sc01_score_model",
    fx.with_sql(fx.POSTS_SQL) + "SELECT post_id, truth, true AS decided, true AS sure FROM posts",
)
def _(spark, d):
    posts = topics.tokenize(fx.posts(spark, d))
    model = Pipeline(
        stages=[
            HashingTF(numFeatures=1 << 12, inputCol="tokens", outputCol="features"),
            LogisticRegression(labelCol="truth", maxIter=10, regParam=0.1),
        ]
    ).fit(posts.filter("truth IS NOT NULL"))
    return scoring.score_model(posts, model).select(
        "post_id",
        "truth",
        F.col("decision").isin("Yes", "No").alias("decided"),
        F.col("confidence").between(0.5, 1).alias("sure"),
    )


@query(
    "sc01_score_callable",
    TASKS_SQL
    + f"""SELECT post_id, definition, CASE WHEN length(prompt) % 4 <> 0 THEN {ANSWER_SQL} END AS answer,
       CASE WHEN length(prompt) % 4 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN length(prompt) % 4 = 0 THEN 'injected fault' END AS error FROM tasks""",
)
def _(spark, d):
    scored = scoring.score_callable(tasks(spark, d), make_scorer, max_retries=0)
    return scored.select("post_id", "definition", "answer", "status", "error")


@query("sc02_row_faults", TASKS_SQL + f"SELECT post_id, definition, {PARSED_SQL} FROM tasks")
def _(spark, d):
    scored = scoring.score_rule(tasks(spark, d), rule_answer(), fault())
    return scoring.parse_scored(scored).select("post_id", "definition", "decision", "explanation")


@query(
    "sc03_quarantine",
    TASKS_SQL
    + "SELECT post_id, definition, 'injected fault' AS error FROM tasks WHERE length(prompt) % 4 = 0",
)
def _(spark, d):
    scored = scoring.score_rule(tasks(spark, d), rule_answer(), fault())
    return scoring.quarantine(scored).select("post_id", "definition", "error")


@query(
    "sc04_retries",
    TASKS_SQL
    + """SELECT post_id, definition, 'ok' AS status,
       CAST(CASE WHEN length(prompt) % 4 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM tasks""",
)
def _(spark, d):
    one_per_prompt = tasks(spark, d).withColumn(
        "prompt", F.concat(F.col("prompt"), F.lit(" "), F.lpad(F.col("post_id").cast("string"), 19, "0"))
    )
    scored = scoring.score_callable(one_per_prompt, make_flaky_scorer, max_retries=2, delay=0.0)
    return scored.select("post_id", "definition", "status", "attempts")


# eight requests of a task at once; those that fail wait while others are asked
@query(
    "sc04_score_in_flight",
    TASKS_SQL
    + f"""SELECT post_id, definition, CASE WHEN length(prompt) % 4 <> 0 THEN {ANSWER_SQL} END AS answer,
       CAST(CASE WHEN length(prompt) % 4 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM tasks""",
)
def _(spark, d):
    scored = scoring.score_callable(tasks(spark, d), make_scorer, max_retries=2, delay=0.01, in_flight=8)
    return scored.select("post_id", "definition", "answer", "attempts")


@query(
    "sc04_resubmit_failed",
    TASKS_SQL
    + """SELECT post_id, definition, CASE WHEN length(prompt) % 4 = 0 THEN 'failed' ELSE 'ok' END AS status FROM tasks""",
)
def _(spark, d):
    def attempt(pending):
        return scoring.score_callable(pending, make_scorer, max_retries=0)

    return scoring.resubmit_failed(tasks(spark, d), attempt, rounds=2).select(
        "post_id", "definition", "status"
    )


@query(
    "sc01_score_in_waves",
    TASKS_SQL + f"SELECT post_id, definition, {ANSWER_SQL} AS answer FROM tasks",
)
def _(spark, d):
    """A run that was stopped, gone on with another number of waves and with added tasks."""
    path, all_tasks = scratch_path(spark, "waves"), tasks(spark, d)
    waves = []

    def stopping(part):
        waves.append(part)
        if len(waves) == 2:
            raise InterruptedError("the run is stopped")
        return scoring.score_rule(part, rule_answer())

    try:
        scoring.score_in_waves(all_tasks.filter("post_id % 3 <> 0"), stopping, path, 3)
    except InterruptedError:
        pass
    scored = scoring.score_in_waves(all_tasks, lambda part: scoring.score_rule(part, rule_answer()), path, 2)
    return scored.select("post_id", "definition", "answer")


@query(
    "sc05_fallback",
    TASKS_SQL
    + """SELECT post_id, definition, CASE WHEN quality = 0 THEN 'context' ELSE 'plain' END AS mode,
       md5(CASE WHEN quality = 0 THEN keyword || repeat(chr(10), 2) || 'With context: ' || text ELSE prompt END) AS prompt_md5
FROM tasks""",
)
def _(spark, d):
    contexts = fx.posts(spark, d).filter(F.col("quality") == 0).select(
        "post_id", F.col("keyword").alias("context")
    )
    posts = scoring.with_fallback(fx.posts(spark, d), contexts)
    built = prompts.render_prompts(prompts.build_tasks(posts, two_definitions(spark, d)))
    prepared = built.withColumn("context_prompt", F.concat(F.lit("With context: "), "text"))
    return scoring.choose_prompt(prepared).select(
        "post_id", "definition", "mode", F.md5("prompt").alias("prompt_md5")
    )


@query(
    "sc06_pivot_results",
    TASKS_SQL.rstrip()
    + f""",
parsed AS (SELECT post_id, keyword, definition, {PARSED_SQL} FROM tasks)
SELECT post_id, keyword, max(CASE WHEN definition = 'D0' THEN decision END) AS "D0_Decision",
       max(CASE WHEN definition = 'D0' THEN explanation END) AS "D0_Explanation",
       max(CASE WHEN definition = 'D1' THEN decision END) AS "D1_Decision",
       max(CASE WHEN definition = 'D1' THEN explanation END) AS "D1_Explanation"
FROM parsed GROUP BY post_id, keyword""",
)
def _(spark, d):
    numbered = scoring.with_row_ids(fx.posts(spark, d))
    built = prompts.render_prompts(prompts.build_tasks(numbered, two_definitions(spark, d)))
    scored = scoring.score_once(scoring.score_rule(built, rule_answer(), fault()).drop("prompt", "template"))
    return scoring.pivot_results(scoring.parse_scored(scored), ["post_id", "keyword"], ["D0", "D1"])


@query(
    "sc06_scored_posts",
    TASKS_SQL.rstrip()
    + f""",
parsed AS (SELECT post_id, username, truth, keyword, text, definition, {PARSED_SQL}
           FROM (SELECT t.*, p.username FROM tasks t JOIN posts p ON t.post_id = p.post_id))
SELECT post_id, username, truth, keyword, md5(text) AS text_md5,
       max(CASE WHEN definition = 'D0' THEN decision END) AS "D0_Decision",
       max(CASE WHEN definition = 'D1' THEN decision END) AS "D1_Decision",
       max(CASE WHEN definition = 'D0' THEN CAST(decision = 'Yes' AS INTEGER) END) AS "D0_Binary",
       max(CASE WHEN definition = 'D1' THEN CAST(decision = 'Yes' AS INTEGER) END) AS "D1_Binary"
FROM parsed GROUP BY post_id, username, truth, keyword, text""",
)
def _(spark, d):
    """Posts to decisions: prompts, one run of the scorer, parsing, one row per post."""
    run = score_posts(
        fx.posts(spark, d),
        two_definitions(spark, d),
        lambda built: scoring.score_rule(built, rule_answer(), fault()),
    )
    return run.wide.select(
        "post_id", "username", "truth", "keyword", F.md5("text").alias("text_md5"),
        "D0_Decision", "D1_Decision", "D0_Binary", "D1_Binary",
    )


@query(
    "sc07_confident",
    "SELECT l_orderkey, l_linenumber, 1 - l_discount * 5 AS confidence FROM lineitem WHERE 1 - l_discount * 5 >= 0.7",
)
def _(spark, d):
    scored = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (1 - F.col("l_discount") * 5).alias("confidence")
    )
    return scoring.confident(scored)


@query(
    "sc08_callout_definition",
    TASKS_SQL
    + """SELECT post_id, definition, md5(prompt) AS prompt_md5 FROM tasks
UNION ALL SELECT post_id, 'CALLOUT', md5('Does it call this out? ' || text) FROM posts""",
)
def _(spark, d):
    definitions = prompts.with_callout(two_definitions(spark, d), "Does it call this out? {text}")
    built = prompts.render_prompts(prompts.build_tasks(fx.posts(spark, d), definitions))
    return built.select("post_id", "definition", F.md5("prompt").alias("prompt_md5"))
