"""Queries for text rules, prompts, answers, documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import context, prompts, topics
from runlens.plans import fixtures as fx
from runlens.plans.catalog.registry import query
from runlens.operators.cleaning import clean_posts
from runlens.operators.shape import stack
from runlens.plans.catalog.shape import AB_SQL, parsed
from runlens.sources.definitions import missing_definitions, read_definitions, save_definition
from runlens.sources.storage import scratch_path

STOP_WORDS = ("the", "and", "of", "to", "in", "de", "la", "der", "und")

SPACE, NOT_SPACE, WORD = tx.SPACE, tx.NOT_SPACE, tx.WORD


def clean_sql(text: str) -> str:
    """The cleaning rule for text whose entities are the named ones below."""
    for pattern, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "''"), ("&nbsp;", " "),
    ):
        text = f"replace({text}, '{pattern}', '{char}')"
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    text = f"regexp_replace({text}, 'https?://{NOT_SPACE}+', '', 'g')"
    text = f"regexp_replace({text}, '@{WORD}+', '', 'g')"
    text = f"regexp_replace({text}, '#({WORD}+)', '\\1', 'g')"
    text = f"regexp_replace({text}, '{SPACE}+', ' ', 'g')"
    return f"regexp_replace({text}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


@query(
    "tx01_clean_pages",
    f"SELECT page_id, md5(clean) AS text_md5, CAST(length(clean) AS INTEGER) AS n_chars "
    f"FROM (SELECT page_id, {clean_sql('html')} AS clean FROM pages)",
)
def _(spark, d):
    cleaned = clean_posts(fx.table(spark, d, "pages").select("page_id", "html"), "html", "clean")
    return cleaned.select("page_id", F.md5("clean").alias("text_md5"), F.char_length("clean").alias("n_chars"))


@query(
    "tx01_clean_documents_native",
    f"SELECT doc_id, md5(clean) AS text_md5, CAST(length(clean) AS INTEGER) AS n_chars "
    f"FROM (SELECT doc_id, {clean_sql('text')} AS clean FROM documents)",
)
def _(spark, d):
    documents = fx.table(spark, d, "documents").select("doc_id", "text")
    cleaned = clean_posts(documents, "text", "clean", entities="basic")
    return cleaned.select("doc_id", F.md5("clean").alias("text_md5"), F.char_length("clean").alias("n_chars"))


@query(
    "tx02_outbound_links",
    f"""SELECT page_id, CAST(len(links) AS INTEGER) AS n_links, array_to_string(links, ' ') AS links FROM (
  SELECT page_id, list_filter(string_split_regex(concat('see ', url, ' https://t.co/', page_id, ' ', html), '{SPACE}+'),
         lambda t: regexp_matches(t, '^https?://')
              AND regexp_extract(t, '^https?://([^/?#]*)', 1) NOT IN ('twitter.com', 't.co')) AS links FROM pages)""",
)
def _(spark, d):
    text = F.concat(
        F.lit("see "), "url", F.lit(" https://t.co/"), F.col("page_id").cast("string"), F.lit(" "), "html"
    )
    links = fx.table(spark, d, "pages").select("page_id", tx.outbound_links(text).alias("links"))
    return links.select("page_id", F.size("links").alias("n_links"), F.array_join("links", " ").alias("links"))


def two_definitions(spark, d):
    """A definition per label class of the posts, so the table follows the data."""
    labels = fx.table(spark, d, "labels")
    name = F.concat(F.lit("D"), F.col("toxic").cast("string"))
    return labels.groupBy(name.alias("definition")).agg(
        F.concat(F.lit("Does this fit "), F.first(name), F.lit("? {text}\nDECISION:")).alias("template")
    )


DEFINITIONS_SQL = """definitions AS (
  SELECT DISTINCT 'D' || toxic AS definition,
         'Does this fit D' || toxic || '? {text}' || chr(10) || 'DECISION:' AS template FROM labels)"""


@query(
    "jn02_build_tasks",
    fx.with_sql(fx.POSTS_SQL, DEFINITIONS_SQL)
    + "SELECT post_id, keyword, definition, template FROM posts, definitions",
)
def _(spark, d):
    tasks = prompts.build_tasks(fx.posts(spark, d), two_definitions(spark, d))
    return tasks.select("post_id", "keyword", "definition", "template")


@query(
    "tx03_render_prompts",
    fx.with_sql(fx.POSTS_SQL, DEFINITIONS_SQL)
    + "SELECT post_id, definition, md5(replace(template, '{text}', text)) AS prompt_md5 FROM posts, definitions",
)
def _(spark, d):
    tasks = prompts.build_tasks(fx.posts(spark, d), two_definitions(spark, d))
    return prompts.render_prompts(tasks).select("post_id", "definition", F.md5("prompt").alias("prompt_md5"))


@query(
    "tx04_definitions",
    """SELECT lang AS definition, 'Posts in ' || lang || ': ' || count(*) || chr(10) || '{text}' AS template
FROM documents GROUP BY lang""",
)
def _(spark, d):
    folder = scratch_path(spark, "definitions")
    languages = fx.table(spark, d, "documents").groupBy("lang").count()
    for row in languages.toLocalIterator():
        save_definition(spark, folder, row["lang"], f"Posts in {row['lang']}: {row['count']}\n{{text}}")
    return read_definitions(spark, folder)


@query(
    "tx04_missing_definitions",
    """SELECT DISTINCT source AS definition FROM documents WHERE lower(source) NOT IN (
  SELECT lower(d.source) FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""",
)
def _(spark, d):
    documents, labels = fx.table(spark, d, "documents"), fx.table(spark, d, "labels")
    toxic = labels.filter(F.col("toxic") == 1).select("doc_id")
    available = documents.join(toxic, "doc_id", "left_semi").select(F.upper("source").alias("definition"))
    return missing_definitions(documents.select(F.col("source").alias("definition")), available)


@query(
    "tx05_parse_decisions",
    AB_SQL
    + """SELECT post_id, model, ingest_seq, decision, explanation FROM (
  SELECT post_id, model, NULL AS ingest_seq, decision, explanation FROM parsed_answers_a
  UNION ALL SELECT post_id, model, ingest_seq, decision, explanation FROM parsed_answers_b)""",
)
def _(spark, d):
    posts = fx.posts(spark, d)
    both = stack(fx.answers_a(posts), fx.answers_b(posts))
    return parsed(both).select("post_id", "model", "ingest_seq", "decision", "explanation")


CONTEXT_ANSWER_SQL = """CASE WHEN post_id % 13 = 0 THEN NULL
       WHEN quality = 0 THEN 'Well. decision: yes, because ' || keyword
       WHEN truth = 1 THEN 'Decision: No. ' || username ELSE 'I cannot tell: ' || keyword END"""


@query(
    "tx06_parse_context_decisions",
    fx.with_sql(
        fx.POSTS_SQL, f"answered AS (SELECT post_id, {CONTEXT_ANSWER_SQL} AS answer FROM posts)"
    )
    + """SELECT post_id, CASE WHEN answer IS NULL THEN 'Error' WHEN contains(upper(answer), 'DECISION: YES') THEN 'Yes'
       WHEN contains(upper(answer), 'DECISION: NO') THEN 'No' ELSE 'Unclear' END AS decision,
       coalesce(answer, 'null response') AS explanation FROM answered""",
)
def _(spark, d):
    answer = (
        F.when(F.col("post_id") % 13 == 0, F.lit(None).cast("string"))
        .when(F.col("quality") == 0, F.concat(F.lit("Well. decision: yes, because "), "keyword"))
        .when(F.col("truth") == 1, F.concat(F.lit("Decision: No. "), "username"))
        .otherwise(F.concat(F.lit("I cannot tell: "), "keyword"))
    )
    decision, explanation = tx.parse_context_decision(F.col("answer"))
    return (
        fx.posts(spark, d)
        .select("post_id", answer.alias("answer"))
        .select("post_id", decision.alias("decision"), explanation.alias("explanation"))
    )


# a context template per definition, worded from the tables
CONTEXT_SLOTS = "' | {definition} | {post_id} | {definition_text} | {text}'"


def with_context_template(spark, d):
    sources = fx.table(spark, d, "documents").groupBy("lang").count()
    listed = sources.agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "lang", F.col("count").cast("string")))), "; ").alias("points")
    )
    template = F.concat("points", F.expr(CONTEXT_SLOTS))
    return two_definitions(spark, d).withColumn("context_template", listed.select(template).scalar())


def _context_prompt_sql() -> str:
    sql = "context_template"
    for slot, value in (
        ("definition", "definition"),
        ("post_id", "CAST(post_id AS VARCHAR)"),
        ("definition_text", "'Using the ' || definition || ' definition.'"),
        ("text", "coalesce(text, '')"),
    ):
        sql = f"replace({sql}, '{{{slot}}}', {value})"
    return sql


TEMPLATE_SQL = f"""templates AS (
  SELECT string_agg(lang || ': ' || n, '; ' ORDER BY lang || ': ' || n) || {CONTEXT_SLOTS} AS context_template
  FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))"""


@query(
    "tx07_render_context_prompt",
    fx.with_sql(fx.POSTS_SQL, DEFINITIONS_SQL, TEMPLATE_SQL)
    + f"SELECT post_id, definition, md5({_context_prompt_sql()}) AS prompt_md5 FROM posts, definitions, templates",
)
def _(spark, d):
    tasks = prompts.build_tasks(fx.posts(spark, d), with_context_template(spark, d))
    return prompts.render_context_prompt(tasks, "context_template").select(
        "post_id", "definition", F.md5("context_prompt").alias("prompt_md5")
    )


DOCUMENT_SQL = """docs AS (
  SELECT post_id, username, truth, keyword,
         'Original Tweet: ' || text || repeat(chr(10), 2) || 'Author: ' || username || repeat(chr(10), 2)
         AS document FROM posts)"""


@query(
    "vs01_context_docs",
    fx.with_sql(fx.POSTS_SQL, DOCUMENT_SQL)
    + """SELECT post_id, md5(document) AS document_md5, username AS author, '' AS date, coalesce(truth, 0) AS label, keyword FROM docs""",
)
def _(spark, d):
    docs = context.context_docs(fx.posts(spark, d))
    return docs.select(
        "post_id", F.md5("document").alias("document_md5"), "metadata.author", "metadata.date",
        "metadata.label", "metadata.keyword",
    )


@query(
    "tx09_context_metadata",
    """SELECT d.doc_id AS post_id, d.source AS author, '' AS date, coalesce(l.toxic, 0) AS label, d.lang AS keyword
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, d):
    labels = fx.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("truth"))
    rows = (
        fx.table(spark, d, "documents")
        .join(labels, "doc_id", "left")
        .withColumnsRenamed({"doc_id": "post_id", "source": "username", "lang": "keyword"})
    )
    return context.context_metadata(rows).select("metadata.*")


def turns_in_context(spark, d):
    return context.conversation_context(fx.table(spark, d, "conversations"), depth=None)


@query(
    "tx10_ws07_conversation_context",
    f"""SELECT conv_id, turn, lag(text) OVER c AS parent, CAST(len(thread) AS INTEGER) AS n_thread,
       md5(array_to_string(thread, '|')) AS thread_md5, CAST(len(replies) AS INTEGER) AS n_replies,
       md5(array_to_string(replies, '|')) AS replies_md5
FROM (SELECT *, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS thread,
             coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), []) AS replies
      FROM conversations)
WINDOW c AS (PARTITION BY conv_id ORDER BY turn)""",
)
def _(spark, d):
    return turns_in_context(spark, d).select(
        "conv_id",
        "turn",
        "parent",
        F.size("thread").alias("n_thread"),
        F.md5(F.array_join("thread", "|")).alias("thread_md5"),
        F.size("replies").alias("n_replies"),
        F.md5(F.array_join("replies", "|")).alias("replies_md5"),
    )


DEPTH = 3


@query(
    "tx10_conversation_window",
    f"""SELECT conv_id, turn, CAST(len(thread) AS INTEGER) AS n_thread, md5(array_to_string(thread, '|')) AS thread_md5,
       CAST(len(replies) AS INTEGER) AS n_replies, greatest(r - 1 - {DEPTH}, 0) AS thread_left_out,
       greatest(n - r - {DEPTH}, 0) AS replies_left_out
FROM (SELECT *, row_number() OVER c AS r, count(*) OVER (PARTITION BY conv_id) AS n,
             coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {DEPTH} PRECEDING AND 1 PRECEDING), []) AS thread,
             coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND {DEPTH} FOLLOWING), []) AS replies
      FROM conversations WINDOW c AS (PARTITION BY conv_id ORDER BY turn))""",
)
def _(spark, d):
    turns = fx.table(spark, d, "conversations")
    return context.conversation_context(turns, DEPTH, block=1000).select(
        "conv_id",
        "turn",
        F.size("thread").alias("n_thread"),
        F.md5(F.array_join("thread", "|")).alias("thread_md5"),
        F.size("replies").alias("n_replies"),
        "thread_left_out",
        "replies_left_out",
    )


@query(
    "tx08_context_document",
    f"""SELECT conv_id, turn, md5('Original Tweet: ' || text || repeat(chr(10), 2)
       || CASE WHEN role <> '' THEN 'Author: ' || role || repeat(chr(10), 2) ELSE '' END
       || CASE WHEN parent <> '' THEN 'Replying to: ' || parent || repeat(chr(10), 2) ELSE '' END
       || CASE WHEN len(thread) > 0 THEN 'Previous Tweets in Thread:' || chr(10)
          || array_to_string(list_transform(thread, lambda x: '- ' || x || chr(10)), '') ELSE '' END
       || CASE WHEN len(replies) > 0 THEN chr(10) || 'Replies:' || chr(10)
          || array_to_string(list_transform(replies, lambda x: '- ' || x || chr(10)), '') ELSE '' END) AS document_md5
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS parent,
             list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS thread,
             list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS replies
      FROM conversations)""",
)
def _(spark, d):
    docs = context.context_document(turns_in_context(spark, d).withColumnRenamed("role", "username"))
    return docs.select("conv_id", "turn", F.md5("document").alias("document_md5"))


@query(
    "tx11_chunk_documents",
    """SELECT doc_id, CAST(unnest(range(0, len(starts))) AS INTEGER) AS chunk_no, md5(substr(text, unnest(starts), 1000)) AS chunk_md5
FROM (SELECT doc_id, text, range(1, greatest(length(text) - 200, 1) + 1, 800) AS starts FROM documents WHERE length(text) > 0)""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    return context.chunk_documents(docs, "text").select(
        "doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5")
    )


# the parts follow each other and cover the text; each ends at a line end, a space or the full length
@query(
    "tx11_chunk_at_separators",
    """SELECT doc_id, md5(text) AS text_md5, true AS bounded, true AS overlapping FROM documents WHERE length(text) > 0""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    chunks = context.chunk_documents(docs, "text", separator_aware=True)
    size, overlap = context.CHUNK_SIZE, context.CHUNK_OVERLAP
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))).alias("chunks"))

    def own(chunk, i):
        return F.when(i == 0, chunk["chunk"]).otherwise(F.substr(chunk["chunk"], F.lit(overlap + 1)))

    def continues(chunk, i):
        last = F.col("chunks")[F.greatest(i - 1, F.lit(0))]["chunk"]
        return (i == 0) | (F.left(chunk["chunk"], F.lit(overlap)) == F.right(last, F.lit(overlap)))

    return listed.select(
        "doc_id",
        F.md5(F.array_join(F.transform("chunks", own), "")).alias("text_md5"),
        F.forall("chunks", lambda c: F.char_length(c["chunk"]) <= size).alias("bounded"),
        F.forall(F.transform("chunks", continues), lambda same: same).alias("overlapping"),
    )


TOKENS_SQL = (
    f"list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'), "
    f"lambda t: t NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))"
)


@query(
    "tx12_tokenize",
    f"""SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5
FROM (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents)""",
)
def _(spark, d):
    tokenized = topics.tokenize(fx.table(spark, d, "documents"), stop_words=STOP_WORDS)
    return tokenized.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5")
    )


@query(
    "tm01_vocabulary",
    f"""WITH tokens AS (SELECT doc_id, {TOKENS_SQL} AS tokens FROM documents),
terms AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM tokens) GROUP BY term)
SELECT term, df FROM terms WHERE df >= 2 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM documents)""",
)
def _(spark, d):
    documents = fx.table(spark, d, "documents").select("doc_id", "text")
    return topics.vocabulary(topics.tokenize(documents, stop_words=STOP_WORDS))


@query(
    "tx13_escape_markup",
    "SELECT page_id, md5(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS html_md5 FROM pages",
)
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.md5(tx.escape_markup(F.col("html"))).alias("html_md5"))
