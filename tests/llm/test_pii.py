import itertools
import random
import re

import numpy as np
import pytest

from runlens.llm import pii
from runlens.llm.queries import QUERIES

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def checks(digits):
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                16 <= len(digits) <= 19 and checks(digits),
                8 <= len(digits) <= 15,
            )
            if good[kind]:
                found.append((kind, *m.span()))
    return found


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    letters, weights = "0123456789.+-@ ab(é\n", [3] * 10 + [6, 2, 2, 4, 3, 2, 2, 1, 1, 1]
    some = 0
    for i in range(20_000):
        text = "".join(rng.choices(letters, weights, k=rng.randint(0, 60)))
        if i % 3 == 0:
            text = text.replace("9", "4111 1111 1111 1111").replace("8", "10.2.3.")
        found = pii.base_spans(text)
        assert found == plain_base(text), text
        some += bool(found)
    assert some > 2_000


def plain_marginals(own, linked, group, model):
    """Sum over all labelings, the consistency variables included."""
    n, k = own.shape
    hubs = sorted({g for g in group if g >= 0})
    found = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        pairs = sum(model.pair[y[i - 1], y[i]] for i in range(1, n) if linked[i])
        weight = np.exp(sum(own[i, y[i]] for i in range(n)) + pairs)
        for g in hubs:
            weight *= sum(np.exp(model.agree * sum(y[i] == z for i in range(n) if group[i] == g)) for z in range(k))
        for i in range(n):
            found[i, y[i]] += weight
    return found / found.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("linked, group, tolerance", [
    ([0, 1, 1, 0, 1], [-1, -1, -1, -1, -1], 1e-6),
    ([0, 0, 0, 0, 0], [0, 0, -1, 0, -1], 1e-6),
    ([0, 1, 0, 1, 0], [0, -1, 0, -1, -1], 1e-6),
    ([0, 1, 0, 1, 0], [0, -1, 0, -1, -1], 1e-6),
    ([0, 1, 1, 1, 0], [0, -1, 1, 0, 1], 0.06),  # with loops it is an approximation
])
def test_messages_against_enumeration(linked, group, tolerance):
    rng = np.random.default_rng(7)
    model = pii.FieldModel(np.zeros((1, 3)), rng.normal(size=(3, 3)), 1.5)
    own = rng.normal(size=(5, 3))
    linked = np.array(linked, bool)
    found = pii.marginals(own, linked, np.array(group), model)
    assert np.abs(found - plain_marginals(own, linked, np.array(group), model)).max() < tolerance


@pytest.fixture(scope="module")
def model(spark, documents):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeghilmnorst", k=6)) for _ in range(300)]
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for i in range(600):
        text = rng.choices(words, k=20)
        kind = i % 8
        if kind < 3:
            text[7] = f"+1 ({number(3)}) 555-{number(4)}"
        elif kind == 3:
            text[9] = f"{rng.choice(words)}.{number(2)}@mail{number(1)}.example.com"
        elif kind == 4:
            text[9] = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        elif kind == 5:
            text[3] = f"4.{number(1)}"
        else:
            text[4] = rng.choice(["2024", "A" + number(7), number(3)])
        rows.append((i, " ".join(text)))
    return pii.fit_field(documents(rows))


def spans(documents, model, rows):
    found = pii.find_personal_data(documents(rows), model).collect()
    texts = dict(rows)
    return {r.doc_id: [(s.kind, (texts[r.doc_id] or "")[s.start : s.end], s.base) for s in r.spans] for r in found}


def test_distant_similar_tokens_agree(documents, model):
    found = spans(documents, model, [
        (1, "call +1 (212) 555-0142 before noon or else the desk at 555-0142 after that"),
        (2, "the desk at 555-0142 after that"),
    ])
    assert ("phone", "+1 (212) 555-0142", True) in found[1]
    assert ("phone", "555-0142", False) in found[1]


def test_two_entities_in_one_match_are_found_by_the_field(documents, model):
    # the phone pattern takes both numbers and fails by its count of digits
    text = "now +1 (212) 555-0142 4111111111111111 there"
    assert plain_base(text) == []
    assert ("phone", "+1 (212) 555-0142", False) in spans(documents, model, [(1, text)])[1]


def test_clean_documents_stay_clean(documents, model):
    found = spans(documents, model, [(1, "version 4.0. of 2024, chapter 3"), (2, "no number at all"), (3, None), (4, ""), (5, "A1234567")])
    assert all(not s for s in found.values())


def test_defined_cases(spark, documents, model, with_clashes):
    rows = [(1, "x +1 (212) 555-0142"), (1, "x +1 (212) 555-0142"), (None, "a.b@c.de"), (2, "é a.b@c.de")]
    found = pii.find_personal_data(with_clashes(documents(rows)), model).collect()
    assert sorted((r.doc_id or 0, len(r.spans)) for r in found) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert [s.start for r in found if r.doc_id == 2 for s in r.spans] == [2]
    assert pii.find_personal_data(documents(rows).limit(0), model).count() == 0
    assert pii.fit_field(documents(rows).limit(0)) is None
    assert pii.fit_field(documents([(1, "no number")])) is None
    assert spans(documents, None, [(1, "mail a.b@c.de")]) == {1: [("email", "a.b@c.de", True)]}


@pytest.mark.parametrize("part", ["1", "a", "1 ", "a@", "1.1.", "+1", "0.0.0.", "@", "+1 "])
def test_very_long_texts(part):
    text = part * (600_000 // len(part))
    assert isinstance(pii.base_spans(text), list)
    assert len(pii.tokens_of(text).spans) > 0 or part == "a"


def test_more_than_4300_zeros():
    text = "0" * 5_000 + "1.2.3.4"
    assert pii.base_spans(text) == [(1, 0, len(text))]


def test_query_against_plain_scan(spark):
    """Base columns by plain patterns; all spans by the field of one document at a time."""
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = pii.fit_field(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op11_personal_data"](spark, "/root/testdata/sf0.01").collect():
        base = plain_base(texts[r.doc_id])
        spell = lambda found: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(spell(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        own, added = pii.scan([texts[r.doc_id]], fitted)[0]
        assert r.spans == spell(sorted(own + added)) and own == base
