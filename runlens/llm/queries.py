"""The operators as queries over the test tables, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm.bpe import encode_texts
from runlens.llm.chat_format import END, CONTENT, START, format_chats, loss_text, read_turns, text_part
from runlens.llm.exact_dedup import exact_duplicates
from runlens.llm.fingerprints import as_text, fingerprint_documents
from runlens.llm.hard_negatives import mine_hard_negatives
from runlens.llm.language_id import fit_languages, identify_languages
from runlens.llm.merkle import FIELDS, leaf_digest, merkle_manifest
from runlens.llm.minhash_dedup import near_duplicates
from runlens.llm.packing import pack_documents
from runlens.llm.pii import KINDS, find_personal_data, fit_field, spelled
from runlens.llm.secret_scan import BASE, find_secrets
from runlens.llm.substring_dedup import remove_repeated_windows
from runlens.llm.toxicity import fit_toxicity, score_toxicity
from runlens.plans.catalog.registry import Run
from runlens.plans.fixtures import table

QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


@_query(r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@_query(r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
n AS (SELECT doc_id, words, len(words) AS n_words FROM w),
win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS said
  FROM n, unnest(range(1, n_words - 11)) AS t(i)),
least AS (SELECT said, min(doc_id) AS first_id FROM win GROUP BY said),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (said) WHERE first_id < doc_id)
  GROUP BY doc_id),
flat AS (
  SELECT doc_id, n_words, list_filter(words, lambda x, i: NOT list_contains(coalesce(places, []), i)) AS kept
  FROM n LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM flat""")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@_query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


@_query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(_remainder(4) != 2))
    return identify_languages(docs, model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score"
    )


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(_remainder(5) != 0))
    return score_toxicity(docs, model).select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@_query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
    )
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    texts = {name: as_text(F.col(name)) for name in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(texts)


@_query()
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


_ESCAPES = r"len(regexp_extract_all({0}, '\\|<\|[A-Za-z_]+\|>|</?s>|<</?SYS>>|\[/?INST\]'))"


@_query(rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")}
             + {len(START + CONTENT + END)}) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g""")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(
        """SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role,
                  '</s>[INST] ok [/INST]' AS text
           FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""
    )
    chats = format_chats(
        turns.unionByName(hard).select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))
    )
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@_query()
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_personal_data(docs, fit_field(docs))
    base = F.filter("spans", lambda s: s["base"])

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans")
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
# the checksum of the id's digits, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, k: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""
_REDUCE = """{name} AS (
  SELECT tree, 0 AS level, place, n, digest FROM {start}
  UNION ALL
  SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8, n)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@_query(
    f"""WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {_LEAF.format(_FIELD.format("text"))} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(_FIELD.format(f"translate(text, '{_UPPER}', '{_LOWER}')"))} END AS claim
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM rows),
leaves AS (SELECT tree, place, n, leaf AS digest FROM placed),
{_REDUCE.format(name="inner_nodes", start="leaves")},
subroots AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS n, digest FROM inner_nodes WHERE n = 1),
{_REDUCE.format(name="top_nodes", start="subroots")},
nodes AS (
  SELECT 0 AS phase, * FROM inner_nodes WHERE n > 1 UNION ALL SELECT 1, * FROM top_nodes WHERE n > 1),
runs AS (
  SELECT phase, tree, level, place // 8 AS run, list(digest ORDER BY place) AS digests
  FROM nodes GROUP BY phase, tree, level, place // 8),
steps AS (
  SELECT doc_id, leaf, claim, row_number() OVER (PARTITION BY doc_id, leaf, p.place ORDER BY phase, level) AS step,
         p.tree AS own_tree, p.place AS own_place, digests,
         CASE phase WHEN 0 THEN (p.place // CAST(8 ** level AS BIGINT)) % 8 ELSE (p.tree // CAST(8 ** level AS BIGINT)) % 8 END AS spot
  FROM placed p JOIN runs r ON r.tree = CASE phase WHEN 0 THEN p.tree ELSE 0 END
   AND run = CASE phase WHEN 0 THEN p.place ELSE p.tree END // CAST(8 ** (level + 1) AS BIGINT)),
proofs AS (
  SELECT own_tree, own_place, sha256(string_agg(
      array_to_string(list_filter(digests, lambda d, i: i <> spot + 1), ''), '' ORDER BY step)) AS proof
  FROM steps GROUP BY own_tree, own_place),
fold AS (
  SELECT tree, place, 0 AS step, coalesce(claim, leaf) AS digest FROM placed
  UNION ALL
  SELECT tree, place, s.step, sha256(array_to_string(
      list_transform(digests, lambda d, i: CASE WHEN i = spot + 1 THEN f.digest ELSE d END), ''))
  FROM fold f JOIN steps s ON s.own_tree = f.tree AND s.own_place = f.place AND s.step = f.step + 1),
ends AS (SELECT tree, place, arg_max(digest, step) AS folded_root FROM fold GROUP BY tree, place),
root AS (SELECT digest AS root FROM top_nodes WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed p JOIN ends e USING (tree, place) JOIN subroots s ON s.place = p.tree CROSS JOIN root
LEFT JOIN proofs ON own_tree = p.tree AND own_place = p.place"""
)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = [F.translate("text", _UPPER, _LOWER) if f == "text" else F.col(f) for f in FIELDS]
    return merkle_manifest(docs, F.when(_remainder(3) == 0, leaf_digest(tampered)))


@_query("""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), moved)
