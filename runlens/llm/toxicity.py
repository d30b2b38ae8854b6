"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns homoglyphs and digit substitutions into letters and
punctuation into spaces. The lexicon is learned from labelled rows: whole words, and
beginnings of words for forms that vary. A match covered by an exception phrase does
not count. Weights are summed, normalised by length, and turned into a probability
by a two-feature logistic model fitted on labelled rows the lexicon has not seen.

Both fits use about ``sample`` labelled documents, drawn by a hash of the id. The lexicon
has up to ``max_entries`` entries, made of words of 3 to 30 letters and their beginnings.

Defined cases: a null or empty text scores like a text without matches; very long texts
are matched whole; rows that repeat an id are scored each, and the smallest text of an id is
learned from; a document with several labels is toxic if one says so; equal scores are
no tie to break; rows
without label are not learned from; without labelled rows of both kinds every score
is the share of toxic labels (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.language_id import sample_rows
from runlens.llm.tokens import in_slices
from runlens.sources.storage import bounded_rows, materialize

# Letters that look like Latin ones, and characters written for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i", "!": "i"}
_SPACE = {c: " " for c in map(chr, range(128)) if not c.isalnum()}
_ZERO_WIDTH = {c: "" for c in "\u200b\u200c\u200d\u2060\ufeff\u00ad"}
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF41, 0xFF5B)}
_FOLD = str.maketrans(_SPACE | _ZERO_WIDTH | _WIDE | _LOOKALIKES | _DIGITS | {"!": " ", "|": " "})
_PREFIXES = (4, 5, 6)

EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish")


def fold(text: str) -> str:
    """Folded text between two spaces."""
    return f" {text.lower().translate(_FOLD)} "


def entries_of(text: str) -> set[str]:
    """Candidate entries: ``" word "`` and ``" pref"``."""
    words = set(fold(text).split())
    found = {f" {w} " for w in words if 3 <= len(w) <= 30}
    for n in _PREFIXES:
        found |= {" " + w[:n] for w in words if len(w) > n}
    return found


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, float, float]


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str]):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            padded = fold(phrase)
            self.automaton.add_word(padded, (len(padded), None))
        self.empty = not lexicon
        if lexicon or exceptions:
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """Summed weight, damped, and the weight of a hundred words."""
        if self.empty or not text:
            return 0.0, 0.0
        folded = fold(text)
        hits = [(end - size, end, weight) for end, (size, weight) in self.automaton.iter(folded)]
        if not hits:
            return 0.0, 0.0
        covered = [(start, end) for start, end, weight in hits if weight is None]
        best: dict[int, float] = {}  # one weight per word: the heaviest entry that starts there
        for start, end, weight in hits:
            if weight is not None and not any(a <= start and end <= b for a, b in covered):
                best[start] = max(weight, best.get(start, 0.0))
        total = sum(best.values())
        return math.log1p(total), min(20.0, 100 * total / (folded.count(" ") + 20))


def _lexicon(rows: DataFrame, most: int) -> dict[str, float]:
    """Entries that come in toxic rows far more often than chance, by the G test."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out():
            names, both = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64())],
                names=["entry", "clean", "toxic"],
            )
            seen.clear()

        for batch in in_slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for entry in entries_of(text):
                    seen.setdefault(entry, [0, 0])[toxic] += 1
                if len(seen) > 300_000:
                    yield from out()
        yield from out()

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean_rows, toxic_rows = size.get(0, 0), size.get(1, 0)
    if not clean_rows or not toxic_rows:
        return {}
    counts = materialize(
        rows.select("text", "toxic")
        .mapInArrow(count, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "entries",
    )
    clean, toxic = F.col("clean"), F.col("toxic")
    all_rows = clean_rows + toxic_rows
    expected = (clean + toxic) * (toxic_rows / all_rows)
    expected_clean = (clean + toxic) * (clean_rows / all_rows)
    part = lambda seen, fit: F.when(seen > 0, seen * F.log(seen / fit)).otherwise(0.0)
    scored = counts.withColumns(
        {
            "g": 2 * (part(toxic, expected) + part(clean, expected_clean)),
            "odds": F.log(((toxic + 0.5) / (toxic_rows + 1)) / ((clean + 0.5) / (clean_rows + 1))),
        }
    )
    # with n candidates, chance alone reaches about 2 ln n
    least = 2 * math.log(max(2, counts.count()))
    found = scored.filter((F.col("g") > least) & (F.col("odds") > 2)).orderBy(F.col("g").desc(), "entry").limit(most)
    lexicon = _without_nested({r["entry"]: (r["odds"], r["toxic"]) for r in found.collect()})
    return lexicon


def _beginnings(entry: str) -> list[str]:
    return [entry[: n + 1] for n in _PREFIXES if n + 1 < len(entry)]


def _without_nested(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Entries by weight, each family of words once.

    A beginning that one longer entry accounts for is replaced by it; of what is
    left, an entry goes when a beginning of it weighs about as much.
    """
    replaced = {
        b
        for entry, (_, toxic) in found.items()
        for b in _beginnings(entry)
        if b in found and toxic >= 0.9 * found[b][1]
    }
    kept: dict[str, float] = {}
    for entry in sorted(found.keys() - replaced, key=lambda e: (len(e), e)):
        odds = found[entry][0]
        if not any(kept.get(b, -math.inf) >= odds - 1 for b in _beginnings(entry)):
            kept[entry] = float(odds)
    return kept


def _logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge logistic model with intercept."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    max_entries: int = 20_000,
    exceptions: Sequence[str] = EXCEPTIONS,
) -> ToxicityModel:
    """Fit on ``docs`` (``doc_id, text``) with ``labels`` (``doc_id, toxic``).

    At most about ``sample`` labelled rows are used, so their labels can be shipped
    to the texts instead of moving the texts.
    """
    own = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    drawn = sample_rows(own, "doc_id", sample)
    rows = materialize(
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(drawn), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(3))),
        "labelled",
    )
    lexicon = _lexicon(rows.filter("fold < 2"), max_entries)
    matcher_args = lexicon, tuple(exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*matcher_args)
        for batch in in_slices(batches):
            found = [matcher.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())],
                names=["toxic", "damped", "dense"],
            )

    held = rows.filter("fold = 2").select("text", F.col("toxic").cast("int").alias("toxic"))
    # three numbers a row; the draw is near ``sample``, never twice of it
    data = bounded_rows(held.mapInArrow(features, "toxic int, damped double, dense double"), 2 * sample + 100, "labelled rows")
    y = np.array([r["toxic"] for r in data], float)
    if not lexicon or not len(y) or y.min() == y.max():
        share = (y.sum() + 1e-3) / (len(y) + 1.0) if len(y) else 0.0
        weights = (math.log(max(share, 1e-9) / (1 - share)), 1.0 if lexicon else 0.0, 0.0)
    else:
        weights = tuple(map(float, _logistic(np.array([[r["damped"], r["dense"]] for r in data]), y)))
    return ToxicityModel(lexicon, tuple(exceptions), weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; only the text is looked at."""
    # plain values, which executors can read without this package
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shipped.value)
        matcher = Matcher(model.lexicon, model.exceptions)
        bias, damped, dense = model.weights
        for batch in in_slices(batches):
            scores = []
            for text in batch.column(1).to_pylist():
                a, b = matcher.features(text)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + damped * a + dense * b)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, score double")
