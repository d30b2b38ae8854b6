import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm.secret_scan import BASE, RULES, find_secrets, redact_secrets, scan_block, trigram_query

KEY = "AKIA" + "A1B2" * 4
TEXTS = [
    None, "", f"x {KEY} y", "AKIA", "password: 'hunter2x'", "PassWord = \"abcd\"", "api_key=abcdefghij token=ABCDEFGH", "passſword=abcdefgh",
    "tokens: abcdefgh12", "0" * 31, "é" + "f" * 32 + "g", "secret=password=abcdefgh", "password: 'secret'=\"abcdefgh12\"",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "eyJhbGciOi.eyJzdWIiOi.abcdefghij", "xoxb-1234567890-x", "sk_live_" + "a1" * 8,
    "word " * 50_000 + "token=abcdefgh1", f"{KEY} {'a' * 40} password={'b' * 40}",
]


def brute(text):
    text = text or ""
    found = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert scan_block([text or ""], BASE)[0] == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"AKIaf09:='\" é\n", "password", "TOKEN", "AKIA", "f" * 20, "Z9" * 6]), max_size=14))
def test_base_spans_of_fragments(parts):
    text = "".join(parts)
    assert scan_block([text], BASE)[0] == brute(text)


def test_queries():
    assert trigram_query("[0-9a-f]{32,}") is None
    assert trigram_query("AKIA[A-Z0-9]{12,}") == ("and", ("aki", "kia"))
    assert trigram_query("ab") is None
    assert trigram_query("a?xyz") == ("or", (("and", ("axy", "xyz")), "xyz"))
    assert trigram_query("(abc|d+)") is None
    assert trigram_query("(abcd|xyz)[0-9]+") == ("or", (("and", ("abc", "bcd")), "xyz"))
    unindexed = [r.kind for r in RULES if trigram_query(r.pattern) is None]
    assert unindexed == ["hex"]


def test_index_gives_what_a_full_scan_gives():
    rng = random.Random(4)
    texts = ["".join(rng.choices([t or "" for t in TEXTS[:-2]] + [" ", "a", "tok", "en"], k=6)) for _ in range(200)]
    full = [
        sorted(
            (m.start(), o, r.kind, m.end())
            for o, r in enumerate(RULES)
            for m in r.compiled().finditer(t)
            if m.end(r.group) - m.start(r.group) >= r.least
        )
        for t in texts
    ]
    assert scan_block(texts, RULES) == [[(k, s, e) for s, _, k, e in own] for own in full]


def test_table(documents, with_clashes):
    rows = [*enumerate(TEXTS), (0, KEY), (0, KEY)]
    found = find_secrets(with_clashes(documents(rows)), BASE).collect()
    got = sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in found)
    assert got == sorted((i, brute(t)) for i, t in rows)
    assert find_secrets(documents([])).collect() == []


def test_redaction(documents):
    docs = documents([(1, f"a {KEY} b"), (2, None), (3, "clean"), (4, "token=" + "a" * 40)])
    found = redact_secrets(docs)
    assert found.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in found.collect()}
    assert got == {1: ("a [access] b", 12), 2: (None, 0), 3: ("clean", 5), 4: ("[assign]", 8)}
