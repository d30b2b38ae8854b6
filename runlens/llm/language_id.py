"""Language identification: known words first, then ever shorter character n-grams.

Each known word adds its log frequency per language. An unseen word adds the mean
log frequency of its known n-grams of the longest length that has any.

The model is fitted on up to about ``sample`` labelled rows of each language, drawn by a
hash of the id, and holds up to ``max_words`` words and ``max_grams`` n-grams of each
language, the most frequent ones (of words up to 40 letters; longer ones are judged by
n-grams). So it grows with the number of languages only, and rare languages are learned
like frequent ones. Frequencies are kept per language that has a word, not as a full table.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text
whose words share no n-gram with the model gets the most frequent language at the
score of its share; ties go to the first language in order; very long texts are counted
by different words; rows that repeat are judged each; rows without label or text are not
learned from; any text may name a language; with no labelled row everything is ``und``;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import in_slices
from runlens.operators.ranking import top_n_per_group
from runlens.sources.storage import materialize

# On 2,499 held-out rows in the learned languages the share of known letters is 0.83 or more
# with a model of 500 rows; of five texts in languages not learned (zh, ru, ar, pl, fi) none had more than 0.31.
MIN_KNOWN = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "\x00"  # stands before and after a word in its n-grams
_TELLING = 3  # shorter n-grams are shared by many languages


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies: ``base`` of what a language does not have, by kind, and what is above it.

    Kind 0 is words, kind n is n-grams of n letters. Entry i has ``gains`` of ``columns``
    from ``starts[i]`` to ``starts[i + 1]``, each for a language that has it.
    """

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    kinds: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    gains: np.ndarray
    base: np.ndarray
    prior: np.ndarray
    longest: int

    def total(self, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of the entries' log frequencies, per language."""
        found = np.bincount(self.kinds[entries], weights, len(self.base)) @ self.base
        first, many = self.starts[entries], self.starts[entries + 1] - self.starts[entries]
        place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        return found + np.bincount(self.columns[place], self.gains[place] * np.repeat(weights, many), len(self.languages))


def sample_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of ``key``; all when there are fewer."""
    total = rows.count()
    if total <= most:
        return rows
    buckets = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(buckets)) < buckets * most // total)


def _sampled_by(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """About ``most`` rows of each group, chosen by a hash of ``key``; all of smaller groups."""
    buckets = 1 << 30
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(buckets)) * F.col("_size") < F.lit(buckets * most)
    # a row per language, like the model that is shipped later
    return rows.join(F.broadcast(sizes), group).filter(drawn).drop("_size")


def fit_languages(
    labelled: DataFrame,
    sample: int = 2_000,
    max_words: int = 15_000,
    max_grams: int = 15_000,
    longest: int = 4,
) -> LanguageModel:
    """Fit on ``doc_id, text, lang`` rows; all bounds hold per language."""
    usable = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    words = materialize(
        _sampled_by(usable, "lang", "doc_id", sample)
        .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("entry"))
        .filter(F.char_length("entry").between(1, 40))
        .groupBy("lang", "entry")
        .agg(F.count(F.lit(1)).alias("n")),
        "words",
    )
    marked = F.concat(F.lit(_MARK), F.col("entry"), F.lit(_MARK))
    grams = (
        words.select(
            "lang",
            "n",
            F.explode(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.lit(longest)),
                        lambda size: F.transform(
                            F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("entry") + 3 - size)),
                            lambda i: F.substr(marked, i, size),
                        ),
                    )
                )
            ).alias("gram"),
        )
        .filter(F.col("gram") != _MARK)
        .groupBy("lang", F.col("gram").alias("entry"))
        .agg(F.sum("n").alias("n"))
    )

    def frequent(counts: DataFrame, most: int) -> list:
        kept = top_n_per_group(counts, ["lang"], [F.col("n").desc(), F.col("entry")], most)
        return sorted(kept.select("entry", "lang", "n").collect())

    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    column = {x: i for i, x in enumerate(languages)}
    seen = np.array([totals[x] for x in languages], float)
    found = [(r, 0) for r in frequent(words, max_words)] if languages else []
    if languages:
        found += sorted([(r, len(r["entry"])) for r in frequent(grams, max_grams)], key=lambda x: (x[1], x[0]))
    names: list[dict[str, int]] = [{} for _ in range(longest + 1)]  # entries by kind
    kinds, starts = [], []
    for i, (r, kind) in enumerate(found):
        if r["entry"] not in names[kind]:
            names[kind][r["entry"]] = len(kinds)
            kinds.append(kind)
            starts.append(i)
    columns = np.array([column[r["lang"]] for r, _ in found], np.int64)
    counts = np.array([r["n"] for r, _ in found], float)
    of = np.array([kind for _, kind in found], np.int64)
    base = np.zeros((longest + 1, len(languages)))
    gains = np.zeros(len(found))
    for kind in range(longest + 1):
        own = of == kind
        # frequencies among the words, or among the n-grams of one length
        among = seen if kind == 0 else np.bincount(columns[own], counts[own], len(languages))
        base[kind] = np.log(0.5 / (among + 0.5 * max(1, len(names[kind]))))
        gains[own] = np.log((counts[own] + 0.5) / 0.5)
    return LanguageModel(
        languages,
        names[0],
        {gram: i for own in names[1:] for gram, i in own.items()},
        np.array(kinds, np.int64),
        np.array([*starts, len(found)], np.int64),
        columns,
        gains,
        base,
        seen / seen.sum() if languages else seen,
        longest,
    )


class Scorer:
    def __init__(self, model: LanguageModel, memo: int = 100_000):
        self.model, self.memo = model, memo
        self.unseen: dict[str, tuple[tuple[int, ...], float]] = {}

    def _backed_off(self, word: str) -> tuple[tuple[int, ...], float]:
        """``grams`` and their share of the word's n-grams, 0 for short ones."""
        found = self.unseen.get(word)
        if found is None:
            marked, get = f"{_MARK}{word}{_MARK}", self.model.grams.get
            known: tuple[int, ...] = ()
            share = 0.0
            for n in range(self.model.longest, 0, -1):
                rows = [get(marked[i : i + n]) for i in range(len(marked) - n + 1)]
                known = tuple([r for r in rows if r is not None])
                if known:
                    share = len(known) / len(rows) if n >= _TELLING else 0.0
                    break
            if len(self.unseen) >= self.memo:
                self.unseen.clear()
            found = self.unseen[word] = known, share
        return found

    def grams(self, word: str) -> tuple[int, ...]:
        """Rows of the known n-grams of the longest length that has any."""
        return self._backed_off(word)[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the text's letters that the model knows.

        The letters of a known word count in full, those of another by the share of
        its n-grams of three letters or more that are known; the prior plays no part.
        """
        model = self.model
        if not text or not model.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        counts = Counter(_LETTERS.findall(text.lower()))
        rows: list[int] = []
        weights: list[float] = []
        letters = covered = 0.0
        known = model.words.get
        for word, n in counts.items():
            row = known(word)
            size = n * len(word)
            letters += size
            if row is not None:
                rows.append(row)
                weights.append(n)
                covered += size
            else:
                grams, share = self._backed_off(word)
                rows += grams
                weights += [n / len(grams)] * len(grams) if grams else ()
                covered += size * share
        if not rows:
            best = int(np.argmax(model.prior))
            return model.languages[best], float(model.prior[best]), 0.0
        total = model.total(np.array(rows), np.array(weights, float))
        # mean evidence of a word, counted for twenty words at most: repeated text adds no certainty
        total *= min(1.0, 20 / sum(weights))
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return model.languages[best], float(odds[best] / odds.sum()), covered / letters


def _shipped(docs: DataFrame, model: LanguageModel) -> Broadcast:
    """The model's plain values, which executors can read without this package."""
    return docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))


def identify_languages(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; only the text is looked at."""
    shipped = _shipped(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(*shipped.value))
        for batch in in_slices(batches):
            found = [scorer.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, model: LanguageModel, min_score: float = 0.3, text_col: str = "text", min_known: float = 0.0
) -> DataFrame:
    """``docs`` without rows of no language or a score below ``min_score``; all columns stay.

    Rows that hold less than ``min_known`` of their letters in words and n-grams the
    model knows are left out too, whatever the mix of its languages.
    """
    shipped = _shipped(docs, model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(*shipped.value))
        for batch in in_slices(batches):
            found = [scorer.judge(t) for t in batch.column(place).to_pylist()]
            keep = [lang != "und" and s >= min_score and known >= min_known for lang, s, known in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
