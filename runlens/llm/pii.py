"""Personal data: patterns, and a skip-chain conditional random field around them.

Base spans come from fixed patterns. The field has a variable for every token with a
digit or an at sign; its labels are no entity and the four kinds. Features of a token
and of the word before it give its own potential, tokens that follow each other
directly share a pair potential, and tokens of a document that are equal or similar
(same digits, same name before the at sign) share one consistency variable that
each of them prefers to agree with, which takes one edge per token instead of one per
pair. Base spans fix the labels of their tokens; loopy sum-product messages
carry them to the rest. Tokens whose marginal is sure enough are added as spans.

Weights are fitted here, by pseudo-likelihood: the labels are those of the base
patterns, and every token is seen a second time without its own features, so that the
weights of neighbours and similar tokens are learned too. The fit reads ``sample``
documents with up to ``MOST_TOKENS`` such tokens; a draw by hash of id and text.

Defined cases: a null or empty text has no spans; very long texts are scanned in time
proportional to their length, and their tokens are one field; of spans with one kind
the base ones come as found and added ones never overlap a base span; ties of
labels go to no entity, then to the kind listed first; rows that repeat are scanned
each, and learned from once; with nothing to learn from only base spans are returned; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import in_slices
from runlens.sources.storage import bounded_rows

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4_000
MOST_TOKENS = 256
SURE = 0.9

# The patterns of the base spans. Possessive runs and the check of the
# character before a number give the same matches in one pass over long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SEED = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_INNER = _LOCAL | frozenset("@()")
_TOKEN_END = re.compile(r"[^A-Za-z0-9@._%+()-]")
_GAP = re.compile(r"[\x20.,()-]{1,3}")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*\Z")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_EMAIL_FORM = re.compile(r"[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")

Span = tuple[int, int, int]  # kind, start, end


# --- base spans ------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((2 * d) % 10 + (2 * d) // 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign backwards: the part before it is the longest run that is free."""
    free = 0
    for found in _DOMAIN.finditer(text):
        at = start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = found.end()
            yield start, free


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; end exclusive."""
    found: list[Span] = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if _NUMBER.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((3, *m.span()))
    return found


# --- the field of a document --------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens with a digit or an at sign, and how they hang together."""

    spans: list[tuple[int, int]]
    digits: list[int]
    linked: list[bool]  # follows the token before it directly
    keys: list[str | None]  # equal for similar tokens; None shares nothing
    features: list[list[int]]


# The first features by name; after them come shapes and words before, by hash.
_BIAS, _AT, _EMAIL, _QUAD_OK, _QUAD_OFF, _LUHN, _NO_LUHN, _PLUS, _PLAIN, _LETTERS, _DOT, _HYPHEN, _BRACKET = range(13)
_COUNTS = (2, 4, 7, 15, 19)  # digits, up to
_SHAPES_AT = 13 + len(_COUNTS) + 1
_BUCKETS = 256
N_FEATURES = _SHAPES_AT + 2 * _BUCKETS


def _hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % _BUCKETS


def token_features(token: str, before: str) -> list[int]:
    digits = _NOT_DIGIT.sub("", token)
    found = [_BIAS]
    if "@" in token:
        found.append(_AT)
        if _EMAIL_FORM.fullmatch(token):
            found.append(_EMAIL)
    if _QUAD.fullmatch(token):
        inside = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in token.split("."))
        found.append(_QUAD_OK if inside else _QUAD_OFF)
    if 16 <= len(digits) <= 19:
        found.append(_LUHN if luhn(digits) else _NO_LUHN)
    if token.startswith("+"):
        found.append(_PLUS)
    letters = any(map(str.isalpha, token))
    found.append(_LETTERS if letters else _PLAIN)
    found += [f for c, f in ((".", _DOT), ("-", _HYPHEN), ("(", _BRACKET)) if c in token]
    found.append(13 + sum(len(digits) > c for c in _COUNTS))
    shape = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]", "9", token[:40])))
    found.append(_SHAPES_AT + _hashed(shape))
    if before:
        found.append(_SHAPES_AT + _BUCKETS + _hashed(before))
    return found


def _key(token: str) -> str | None:
    if "@" in token:
        return token.partition("@")[0].strip("(").lower() or None
    digits = _NOT_DIGIT.sub("", token)
    if len(digits) < 5:
        return None
    if "." in token or any(map(str.isalpha, token)):
        return token.lower()
    # a number with and without its prefix; cards and other long ones only as a whole
    return digits[-7:] if len(digits) <= 15 else digits


def tokens_of(text: str) -> Tokens:
    found = Tokens([], [], [], [], [])
    end = 0
    seed = _SEED.search(text)
    while seed:
        start = seed.start()
        while start > end and text[start - 1] in _INNER:
            start -= 1
        stop = _TOKEN_END.search(text, seed.end())
        last, previous = stop.start() if stop else len(text), end
        end = last
        while text[last - 1] in ".-%(":
            last -= 1
        while text[start] in ".-%)_":
            start += 1
        token = text[start:last]
        before = _WORD_BEFORE.search(text[max(0, start - 24) : start])
        found.linked.append(bool(found.spans) and _GAP.fullmatch(text[found.spans[-1][1] : start][:4]) is not None)
        found.spans.append((start, last))
        found.digits.append(len(_NOT_DIGIT.sub("", token)))
        found.keys.append(_key(token))
        found.features.append(token_features(token, before.group(1).lower() if before else ""))
        seed = _SEED.search(text, max(end, previous))
    return found


def labels_of(spans: Sequence[tuple[int, int]], base: Sequence[Span]) -> list[int]:
    """For each token, 1 + the kind of the base span that it meets, else 0; the first listed kind wins."""
    found = [0] * len(spans)
    for kind in reversed(range(len(KINDS))):
        own = [b for b in base if b[0] == kind]
        i = 0
        for k, (start, end) in enumerate(spans):
            while i < len(own) and own[i][2] <= start:
                i += 1
            if i < len(own) and own[i][1] < end:
                found[k] = kind + 1
    return found


def groups_of(keys: Sequence[str | None]) -> list[int]:
    """A number per set of similar tokens, -1 for tokens that are alone."""
    seen: dict[str, int] = {}
    for key in keys:
        if key is not None:
            seen[key] = seen.get(key, 0) + 1
    number = {key: i for i, key in enumerate(k for k, n in seen.items() if n > 1)}
    return [number.get(key, -1) if key is not None else -1 for key in keys]


# --- inference ------------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldModel:
    own: np.ndarray  # features x labels
    pair: np.ndarray  # labels x labels, of tokens that follow each other
    agree: float  # of a token and the variable of its group


def marginals(own: np.ndarray, linked: np.ndarray, group: np.ndarray, model: FieldModel, rounds: int = 50) -> np.ndarray:
    """Label probabilities by loopy sum-product messages; exact where the graph has no loop.

    ``linked`` tells which tokens share a pair potential with the one before them. A
    flooding schedule: in each round all messages are made from those of the last.
    """
    right = np.flatnonzero(linked)
    left = right - 1
    member = np.flatnonzero(group >= 0)
    hub = group[member]
    forward, backward = np.zeros((2, len(right), own.shape[1]))
    down = np.zeros((len(member), own.shape[1]))
    gain = np.expm1(model.agree)

    def log_sum(x: np.ndarray) -> np.ndarray:
        most = x.max(axis=-1, keepdims=True)
        return np.log(np.exp(x - most).sum(axis=-1)) + most[..., 0]

    def agreeing(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return np.log(x.sum(axis=1, keepdims=True) + gain * x)

    centred = lambda x: x - x.mean(axis=1, keepdims=True)

    def total() -> np.ndarray:
        out = own.copy()
        out[right] += forward
        out[left] += backward
        out[member] += down
        return out

    for _ in range(rounds):
        now = total()
        new_forward = centred(log_sum((now[left] - backward)[:, :, None].swapaxes(1, 2) + model.pair.T))
        new_backward = centred(log_sum((now[right] - forward)[:, None, :] + model.pair))
        up = agreeing(now[member] - down)
        at_hub = np.zeros((int(hub.max()) + 1 if len(hub) else 0, own.shape[1]))
        np.add.at(at_hub, hub, up)
        new_down = centred(agreeing(at_hub[hub] - up))
        change = max([np.abs(a - b).max(initial=0) for a, b in ((new_forward, forward), (new_backward, backward), (new_down, down))])
        forward, backward, down = new_forward, new_backward, new_down
        if change < 1e-6:
            break
    found = total()
    found = np.exp(found - found.max(axis=1, keepdims=True))
    return found / found.sum(axis=1, keepdims=True)


_MOST_DIGITS = (0, 0, 19, 15)  # of a span of several tokens, by kind
_FIXED = 30.0  # log odds of a token inside a base span


def own_potentials(features: Sequence[Sequence[int]], labels: Sequence[int], model: FieldModel) -> np.ndarray:
    flat = np.fromiter((f for own in features for f in own), np.int64)
    starts = np.cumsum([0, *(len(f) for f in features[:-1])])
    found = np.add.reduceat(model.own[flat], starts)
    fixed = np.flatnonzero(labels)
    found[fixed] = -_FIXED
    found[fixed, np.asarray(labels)[fixed]] = 0.0
    return found


def added_spans(field: Tokens, labels: Sequence[int], probability: np.ndarray, sure: float) -> list[Span]:
    """Spans of tokens outside base spans whose best label is an entity.

    Neighbours of one kind are one span while it has no more digits than its kind allows.
    """
    found: list[Span] = []
    last, held = -2, 0
    for i, (start, end) in enumerate(field.spans):
        kind = int(np.argmax(probability[i]))
        if labels[i] or not kind or probability[i, kind] < sure:
            continue
        digits = field.digits[i]
        if (
            last == i - 1
            and field.linked[i]
            and found[-1][0] == kind - 1
            and held + digits <= _MOST_DIGITS[kind - 1]
            and (field.keys[i] is None or field.keys[i] != field.keys[last])
        ):
            found[-1], held = (kind - 1, found[-1][1], end), held + digits
        else:
            found.append((kind - 1, start, end))
            held = digits
        last = i
    return found


def scan(texts: Sequence[str], model: FieldModel | None, sure: float = SURE) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text; the fields of all texts are solved together."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, []) for b in base]
    fields = [tokens_of(t) for t in texts]
    labels = [labels_of(f.spans, b) for f, b in zip(fields, base)]
    features = [own for f in fields for own in f.features]
    if not features:
        return [(b, []) for b in base]
    groups, many = [], 0
    for f in fields:
        own = np.array(groups_of(f.keys), np.int64)
        groups.append(np.where(own < 0, -1, own + many))
        many += int(own.max(initial=-1)) + 1
    potentials = own_potentials(features, [x for own in labels for x in own], model)
    linked = np.array([x for f in fields for x in f.linked], bool)
    probability = marginals(potentials, linked, np.concatenate(groups), model)
    found, at = [], 0
    for b, f, own in zip(base, fields, labels):
        n = len(f.spans)
        found.append((b, added_spans(f, own, probability[at : at + n], sure)))
        at += n
    return found


# --- fitting -----------------------------------------------------------------------------------


def _majority(labels: np.ndarray, group: np.ndarray, n_labels: int) -> np.ndarray:
    """The label that most of a token's similar tokens have, -1 without any."""
    found = np.full(len(labels), -1)
    member = np.flatnonzero(group >= 0)
    if len(member):
        counts = np.zeros((int(group.max()) + 1, n_labels))
        np.add.at(counts, (group[member], labels[member]), 1)
        others = counts[group[member]]
        others[np.arange(len(member)), labels[member]] -= 1
        found[member] = np.where(others.any(axis=1), others.argmax(axis=1), -1)
    return found


def fit_weights(features: Sequence[Sequence[int]], labels: np.ndarray, linked: np.ndarray, group: np.ndarray, steps: int = 200) -> FieldModel:
    """Pseudo-likelihood by Adam: each label given its features, neighbours and similar tokens."""
    k = len(KINDS) + 1
    n = len(labels)
    flat = np.fromiter((f for own in features for f in own), np.int64)
    row = np.repeat(np.arange(n), [len(f) for f in features])
    before = np.where(linked, np.r_[0, labels[:-1]], -1)
    after = np.where(np.r_[linked[1:], False], np.r_[labels[1:], 0], -1)
    mates = _majority(labels, group, k)
    target = np.eye(k)[labels]
    has_before, has_after, has_mates = (np.flatnonzero(x >= 0) for x in (before, after, mates))
    # without evidence neighbours and similar tokens tend to agree
    weights = [np.zeros((N_FEATURES, k)), np.eye(k), np.array(4.0)]
    start = [w.copy() for w in weights]
    ridge = (1e-3, 1e-3, 1e-3)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        own, pair, agree = weights
        seen = np.stack([np.bincount(row, own[flat, c], n) for c in range(k)], axis=1)
        context = np.zeros((n, k))
        context[has_before] += pair[before[has_before]]
        context[has_after] += pair[:, after[has_after]].T
        context[has_mates, mates[has_mates]] += agree
        slopes = [r * (w - s) for r, w, s in zip(ridge, weights, start)]
        # once with all features, once with none but the bias
        for part, share, hidden in ((seen, 1.0, False), (np.broadcast_to(own[_BIAS], (n, k)), 0.25, True)):
            x = part + context
            x = np.exp(x - x.max(axis=1, keepdims=True))
            gap = share * (x / x.sum(axis=1, keepdims=True) - target) / n
            if hidden:
                slopes[0][_BIAS] += gap.sum(axis=0)
            else:
                slopes[0] += np.stack([np.bincount(flat, gap[row, c], N_FEATURES) for c in range(k)], axis=1)
            np.add.at(slopes[1], before[has_before], gap[has_before])
            np.add.at(slopes[1].T, after[has_after], gap[has_after])
            slopes[2] = slopes[2] + gap[has_mates, mates[has_mates]].sum()
        for i, slope in enumerate(slopes):
            mean, square = moments[i]
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            weights[i] = weights[i] - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights[2] = np.maximum(weights[2], 0.0)
    return FieldModel(weights[0], weights[1], float(weights[2]))


def fit_field(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> FieldModel | None:
    """Weights from about ``sample`` documents with tokens of the field; None when there is none."""
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(31)), F.lit(1 << 40))
    rows = docs.filter(F.col(text_col).rlike("[0-9@]")).select(drawn.alias("draw"), F.col(text_col).alias("text"))
    total = rows.count()
    if total > sample:
        rows = rows.filter(F.col("draw") < (1 << 40) * sample // total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out = []
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens_of(text)
                if 0 < len(found.spans) <= MOST_TOKENS:
                    labels = labels_of(found.spans, base_spans(text))
                    sizes = [len(f) for f in found.features]
                    out.append((draw, labels, found.linked, groups_of(found.keys), sizes, [x for f in found.features for x in f]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)],
                names=["draw", "labels", "linked", "groups", "sizes", "features"],
            )

    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 3]
    kept = rows.mapInArrow(
        run, "draw long, labels array<int>, linked array<boolean>, groups array<int>, sizes array<int>, features array<int>"
    )
    # a row that repeats is learned from once, and the draw is near ``sample``, never twice of it
    once = kept.groupBy("draw").agg(*[F.any_value(c).alias(c) for c in kept.columns[1:]])
    found = sorted(bounded_rows(once, 2 * sample + 100, "documents to learn from"), key=lambda r: r["draw"])
    if not found:
        return None
    groups, many = [], 0
    for r in found:
        groups += [g + many if g >= 0 else -1 for g in r["groups"]]
        many += max(r["groups"]) + 1
    flat = array("i", [f for r in found for f in r["features"]])
    ends = np.cumsum([n for r in found for n in r["sizes"]])
    return fit_weights(
        [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)],
        np.array([x for r in found for x in r["labels"]]),
        np.array([x for r in found for x in r["linked"]], bool),
        np.array(groups),
    )


# --- the operator -----------------------------------------------------------------------------


def find_personal_data(
    docs: DataFrame, model: FieldModel | None, sure: float = SURE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans`` of every row: ``kind, start, end, base`` by kind as listed, then start."""
    shipped = None if model is None else (model.own, model.pair, model.agree)
    schema = "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = None if shipped is None else FieldModel(*shipped)
        for batch in in_slices(batches):
            out = []
            for base, added in scan(batch.column(1).to_pylist(), field, sure):
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
                out.append([{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "base": s[3]} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
