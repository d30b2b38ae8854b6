"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted words: the weight of a word is the number of times it
occurs times the square of its length (12 characters at most), so that long words,
which say more, count more than the frequent short ones. For each of the
``samples`` draws every word gets two Gamma(2, 1) values and one uniform value from
a hash of the word; the word of smallest ``a`` is the sample, together with its
quantised weight. Two texts share a sample with the probability of their generalised
Jaccard similarity.

Everything is DataFrame expressions. Words are sampled in the task that holds their
text: neither words nor samples move, only texts by id and finished fingerprints.

Defined cases: all texts that are null, empty or white space alone have one
fingerprint, which is like itself only; counts beyond 4,194,303 weigh as that many;
rows that repeat an id get a row each,
their neighbour being the next smaller id; a row without id comes before all others; of several texts with the neighbour's id
the smallest prefix and fingerprint are taken; an only document is its own neighbour;
an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.storage import materialize

SAMPLES = 64
_NO_ID = (1 << 63) - 1  # stands for a missing id, after all others
_WORD_GAP = r"[\x20\x09-\x0D]+"
# A counted word is one number: 38 bits of hash, 22 of its count, 4 of its length.
_LENGTH = 15
_LONGEST = 12
_COUNT = (1 << 22) - 1
_IDENTITY = (1 << 31) - 1


def counted_words(text: Column) -> Column:
    """``array<long>``: a code per different word of a text; the code 0 when it has none."""
    words = F.filter(F.split(text, _WORD_GAP), lambda w: w != "")
    coded = F.transform(
        words,
        lambda w: F.shiftleft(F.xxhash64(w), 26).bitwiseOR(
            F.least(F.char_length(w), F.lit(_LONGEST)).cast("long")
        ),
    )
    return F.sort_array(coded)


def _runs(coded: Column) -> Column:
    """Starts of the runs of equal values in a sorted array, and its length at the end."""
    return F.filter(
        F.sequence(F.lit(0), F.size(coded)),
        lambda i: (i == 0) | (i == F.size(coded)) | (F.get(coded, i) != F.get(coded, i - 1)),
    )


def _with_counts(coded: Column, runs: Column) -> Column:
    def code(start: Column, i: Column) -> Column:
        count = F.least((F.get(runs, i + 1) - start).cast("long"), F.lit(_COUNT))
        return F.get(coded, start).bitwiseOR(F.shiftleft(count, 4))

    starts = F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when(F.size(coded) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(starts, code))


def _product(word_hash: Column, shift: int) -> Column:
    """Logarithm of the product of two uniform values, of twelve bits of a hash each."""
    first = F.shiftright(word_hash, shift).bitwiseAND(F.lit(4095)) + 0.5
    second = F.shiftright(word_hash, shift + 12).bitwiseAND(F.lit(4095)) + 0.5
    return F.log(first * second) - 24 * math.log(2)


def _sample(word_hash: Column, log_weight: Column) -> Column:
    """Order of ``a`` in the high bits, identity of (word, quantised weight) in the low 31.

    A Gamma(2, 1) value is the negative logarithm of a product of two uniform values.
    """
    r = -_product(word_hash, 0)
    log_c = F.log(-_product(word_hash, 24))
    beta = F.shiftrightunsigned(word_hash, 48) * (1 / 65536)
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t - beta + 1.0)
    rank = ((log_a + 128.0) * float(1 << 22)).cast("long")
    identity = word_hash.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(_IDENTITY))
    return F.shiftleft(rank, 31).bitwiseOR(identity)


def fingerprints(words: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``drawn array<long>`` of each row of ``words`` (``keys``, ``words array<long>``).

    ``keys`` must name a row; no shuffle is needed when the rows are already
    partitioned by one of them. The draws of a union of bags are the smaller ones of
    each bag's, so a part that two texts share may be sampled once.
    """
    each = words.select(*keys, F.explode("words").alias("code"))
    length = F.col("code").bitwiseAND(F.lit(_LENGTH))
    count = F.shiftrightunsigned("code", 4).bitwiseAND(F.lit(_COUNT))
    word = F.col("code").bitwiseAND(F.lit(~(_COUNT << 4)))
    weighted = each.select(
        *keys, word.alias("word"), F.log(F.greatest(count * length * length, F.lit(1))).alias("log_weight")
    )
    hashed = weighted.select(
        *keys, "log_weight", *[F.xxhash64("word", F.lit(j)).alias(f"h{j}") for j in range(samples)]
    )
    drawn = hashed.groupBy(*keys).agg(
        *[F.min(_sample(F.col(f"h{j}"), F.col("log_weight"))).alias(f"s{j}") for j in range(samples)]
    )
    return drawn.select(*keys, F.array(*[F.col(f"s{j}") for j in range(samples)]).alias("drawn"))


def union_of(left: Column, right: Column) -> Column:
    """Draws of a union of two disjoint bags; a missing bag is empty."""
    return F.coalesce(F.zip_with(left, right, lambda a, b: F.least(a, b)), left, right)


def identities(drawn: Column) -> Column:
    return F.transform(drawn, lambda s: s.bitwiseAND(F.lit(_IDENTITY)).cast("int"))


def likeness(left: Column, right: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    equal = F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda same: same))
    return equal / F.lit(float(samples))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.array_join(F.transform(fingerprint, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id, next_id``: the next smaller id, and the largest for the smallest one.

    Ids are dealt by ranges and written once; neighbours are found inside a range,
    and across ranges by the ranges' largest ids, one row per range.
    """
    spark = ids.sparkSession
    dealt = ids.select("doc_id").distinct().repartitionByRange("doc_id")
    ranges = materialize(dealt.withColumn("part", F.spark_partition_id()), "ids")
    tops = ranges.groupBy("part").agg(F.max("doc_id").alias("top"))
    # one row per range: a few thousand numbers at most
    below = tops.select(
        "part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("below")
    )
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.col("doc_id").desc()))
    return (
        ranges.withColumn("inside", inside)
        .join(F.broadcast(below), "part")
        .select("doc_id", F.coalesce("inside", "below").alias("next_id"))
    )


def with_edited(docs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``doc_id, next_id, text, edited`` per row of ``docs`` (``doc_id, text``).

    The last third of the code points is replaced by the first as many, or all, of
    the neighbour's text. Only that part of a neighbour's text moves to the document;
    both joins read one exchange of the texts by id, which must not be null.
    """
    sized = docs.select("doc_id", F.char_length("text").alias("n"))
    wanted = (
        sized.groupBy("doc_id")
        .agg(F.max(F.floor(F.col("n") / 3)).alias("need"))
        .join(neighbours, "doc_id")
        .select(F.col("doc_id").alias("asked_by"), F.col("next_id").alias("doc_id"), "need")
    )
    prefixes = (
        docs.join(wanted, "doc_id")
        .select("asked_by", F.col("doc_id").alias("next_id"), F.substr("text", F.lit(1), F.col("need").cast("int")).alias("prefix"))
        .groupBy(F.col("asked_by").alias("doc_id"))
        .agg(F.min("prefix").alias("prefix"), F.first("next_id").alias("next_id"))
    )
    third = F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.char_length("text") - third), F.substr("prefix", F.lit(1), third)
    )
    return docs.join(prefixes, "doc_id", "left").select(
        "doc_id", "next_id", "text", F.coalesce(edited, F.col("text")).alias("edited")
    )


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, with their likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (arrays of
    31-bit numbers), ``near_edited, near_next``.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    edited = with_edited(rows, next_ids(rows)).withColumn("row_key", F.monotonically_increasing_id())
    keys = ["doc_id", "row_key", "next_id", "n_chars", "edited_sha256"]
    coded = edited.select(
        "doc_id",
        "row_key",
        "next_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        counted_words(F.col("text")).alias("own"),
        counted_words(F.col("edited")).alias("changed"),
    )
    with_runs = coded.select("*", _runs(F.col("own")).alias("own_runs"), _runs(F.col("changed")).alias("changed_runs"))
    counted = with_runs.select(
        *keys,
        _with_counts(F.col("own"), F.col("own_runs")).alias("own"),
        _with_counts(F.col("changed"), F.col("changed_runs")).alias("changed"),
    )
    # words that both texts have equally often are sampled once
    parts = counted.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("both").alias("part"), F.array_intersect("own", "changed").alias("words")),
                F.struct(F.lit("own").alias("part"), F.array_except("own", "changed").alias("words")),
                F.struct(F.lit("changed").alias("part"), F.array_except("changed", "own").alias("words")),
            )
        ).alias("p"),
    ).select(*keys, "p.part", "p.words")
    drawn = fingerprints(parts, [*keys, "part"], samples)
    by_part = drawn.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("part", "drawn"))).alias("by_part"))

    def whole(part: str) -> Column:
        return identities(union_of(F.col("by_part")["both"], F.col("by_part")[part]))

    paired = by_part.select(*keys, whole("own").alias("fingerprint"), whole("changed").alias("edited_fingerprint"))
    done = materialize(paired.drop("row_key"), "fingerprints")
    following = (
        done.groupBy(F.col("doc_id").alias("next_id"))
        .agg(F.min("fingerprint").alias("next_fingerprint"))
    )
    return done.join(following, "next_id", "left").select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples), F.lit(0.0)).alias("near_next"),
    )
