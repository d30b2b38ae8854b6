"""Secret scans: Boolean trigram queries over an inverted index, then verification.

For each rule a query of mandatory trigrams is derived from the parsed pattern. An
index of those trigrams is built per block of rows; postings are intersected and
united as the query says, and only the rows that remain are searched with the
pattern. A rule without mandatory trigrams searches every row. Blocks are
slices of the batches Spark reads, so nothing is shuffled and memory is bounded.

Defined cases: a null text counts as empty and has no spans; rows that repeat are
scanned each; long texts are searched whole; an empty table gives an empty table;
spans are in code points, end exclusive, ordered by start, then by rule.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import in_slices


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        any_case=True,
    ),
    # for these two, runs that are too short hold no long enough match, so the length is in the pattern
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Published forms of further credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + MORE

# A query is None (no condition), a trigram, or ("and" | "or", queries).
Query = None | str | tuple[str, tuple]
_WIDEST = 64  # alternatives a literal run may fan out to before it is closed


def _all(parts: Sequence[Query]) -> Query:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", kept)


def _any(parts: Sequence[Query]) -> Query:
    kept = tuple(dict.fromkeys(parts))
    return None if not kept or None in kept else kept[0] if len(kept) == 1 else ("or", kept)


def _literal(text: str) -> Query:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


def _strings(item) -> set[str] | None:
    """The lower-cased strings an item stands for, None when not few."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for what, arg in value:
            if what is op.LITERAL:
                found.add(chr(arg).lower())
            elif what is op.RANGE and arg[1] - arg[0] < 8:
                found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if kind is op.BRANCH:
        branches = [_sequence_strings(b) for b in value[1]]
        return None if None in branches else set().union(*branches)
    if kind is op.MAX_REPEAT and value[:2] == (0, 1):
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | {""}
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for item in items:
        own = _strings(item)
        if own is None or len(found) * len(own) > _WIDEST:
            return None
        found = {a + b for a, b in product(found, own)}
    return found


def _sequence_query(items) -> Query:
    needed: list[Query] = []
    run = {""}
    for item in items:
        own = _strings(item)
        if own is not None and len(run) * len(own) <= _WIDEST:
            run = {a + b for a, b in product(run, own)}
            continue
        needed.append(_any([_literal(s) for s in sorted(run)]))
        run = {""} if own is None else own
        kind, value = item
        if own is not None:
            continue
        if kind is op.SUBPATTERN:
            needed.append(_sequence_query(value[-1]))
        elif kind is op.BRANCH:
            needed.append(_any([_sequence_query(b) for b in value[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            needed.append(_sequence_query(value[2]))
    needed.append(_any([_literal(s) for s in sorted(run)]))
    return _all(needed)


def trigram_query(pattern: str) -> Query:
    """Condition on the trigrams of a lower-cased text that every match implies."""
    return _sequence_query(parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class TrigramIndex:
    """Postings of the given trigrams over one block of lower-cased texts."""

    def __init__(self, texts: Sequence[str], trigrams: set[str]):
        self.rows = np.arange(len(texts))
        self.postings = {
            t: np.fromiter((i for i, text in enumerate(texts) if t in text), np.int64) for t in trigrams
        }

    def candidates(self, query: Query) -> np.ndarray:
        if query is None:
            return self.rows
        if isinstance(query, str):
            return self.postings[query]
        how, parts = query
        found = self.candidates(parts[0])
        for part in parts[1:]:
            if how == "and" and not len(found):
                break
            other = self.candidates(part)
            found = (
                np.intersect1d(found, other, assume_unique=True) if how == "and" else np.union1d(found, other)
            )
        return found


Span = tuple[str, int, int]


def scan_block(texts: Sequence[str], rules: Sequence[Rule]) -> list[list[Span]]:
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex([t.lower() for t in texts], set().union(*map(trigrams_of, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for order, (rule, query) in enumerate(zip(rules, queries)):
        pattern = rule.compiled()
        for i in index.candidates(query):
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), order, m.end()))
    return [[(rules[o].kind, start, end) for start, o, end in sorted(own)] for own in found]


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` of every row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            spans = scan_block(batch.column(1).to_pylist(), rules)
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str, spans: Sequence[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in the text; all rows and columns stay, null texts too."""
    place = docs.columns.index(text_col)
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = batch.column(place).to_pylist()
            spans = scan_block([t or "" for t in texts], rules)
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans)]
            columns = list(batch.columns)
            columns[place] = pa.array(clean, batch.column(place).type)
            if n_chars is not None:
                sizes = [
                    len(c) if s else n for c, s, n in zip(clean, spans, batch.column(n_chars).to_pylist())
                ]
                columns[n_chars] = pa.array(sizes, batch.column(n_chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
