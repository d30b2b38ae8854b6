import math
import random
import re

import pytest

from runlens.llm.toxicity import Matcher, entries_of, fit_toxicity, fold, score_toxicity

BAD = ["idiot", "scum"]
FORMS = ["blegor" + e for e in ("a", "um", "ist", "en", "ix", "or", "est", "ia", "o", "ung")]


def corpus(seed, n=900):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randint(5, 80))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice([*BAD, *FORMS]))
        texts.append((i, " ".join(words)))
        labels.append((i, toxic))
    return texts, labels


@pytest.fixture(scope="module")
def fitted(spark, documents):
    texts, labels = corpus(1)
    return fit_toxicity(documents(texts), spark.createDataFrame(labels, "doc_id long, toxic int"))


def scores(documents, model, rows):
    return {r.doc_id: r.score for r in score_toxicity(documents(rows), model).collect()}


def test_held_out(documents, fitted, with_clashes):
    texts, labels = corpus(2)
    found = {r.doc_id: r.score for r in score_toxicity(with_clashes(documents(texts)), fitted).collect()}
    assert sum((found[i] >= 0.5) == bool(y) for i, y in labels) >= 0.97 * len(labels)


def test_lexicon_has_beginnings_of_varying_words(fitted):
    assert " idiot " in fitted.lexicon and " blegor" in fitted.lexicon
    assert len(fitted.lexicon) < 20


def test_disguises(documents, fitted):
    found = scores(documents, fitted, [(1, "you 1d10t there"), (2, "you іdіоt there"), (3, "You IDIOT!"), (4, "you idle there"), (5, "you id​iot")])
    assert all(found[i] >= 0.5 for i in (1, 2, 3, 5)) and found[4] < 0.5


def test_exceptions():
    matcher = Matcher({" trash ": 3.0, " clown ": 2.0}, ("trash can", "clown fish"))
    assert matcher.features("the trash can and a clown fish") == (0.0, 0.0)
    assert matcher.features("what trash, can it")[0] > 0  # not the phrase
    assert matcher.features("trash and a clown")[0] > matcher.features("a clown")[0] > 0


def test_folding():
    assert fold("S©UM, $cum") == " s©um  scum "
    assert " idiot " in entries_of("an 1d1ot") and " idio" in entries_of("idiots")


def test_defined_cases(spark, documents, fitted):
    found = scores(documents, fitted, [(1, None), (2, ""), (3, "harmless"), (4, "word " * 100_000 + "scum")])
    assert found[1] == found[2] == found[3] < min(0.5, found[4])
    assert score_toxicity(documents([]), fitted).collect() == []


def test_without_labels(spark, documents):
    docs = documents([(i, "some text") for i in range(5)])
    none = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert scores(documents, none, [(1, "idiot")])[1] < 1e-6
    one_kind = fit_toxicity(docs, spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int"))
    assert scores(documents, one_kind, [(1, "idiot")])[1] < 0.1


def test_repeated_rows(spark, documents):
    texts, labels = corpus(3, n=60)
    labelled = spark.createDataFrame(labels * 3, "doc_id long, toxic int")
    model = fit_toxicity(documents(texts * 40), labelled, sample=60)
    once = fit_toxicity(documents(texts), labelled, sample=60)
    assert model == once


def plain_score(model, text):
    """Every entry looked for at every place of the folded text."""
    folded = fold(text)
    covered = [(m.start(), m.start() + len(fold(p))) for p in model.exceptions for m in re.finditer(f"(?={re.escape(fold(p))})", folded)]
    best = {}
    for entry, weight in model.lexicon.items():
        for m in re.finditer(f"(?={re.escape(entry)})", folded):
            a, b = m.start(), m.start() + len(entry)
            if not any(x <= a and b <= y for x, y in covered):
                best[a] = max(weight, best.get(a, 0.0))
    total = sum(best.values())
    bias, damped, dense = model.weights
    odds = bias + damped * math.log1p(total) + dense * min(20.0, 100 * total / (folded.count(" ") + 20))
    return 1 / (1 + math.exp(-odds))


def test_against_plain_search(documents, fitted):
    texts, _ = corpus(4, n=150)
    texts += [(1000, "trash can blegorum idiot scum"), (1001, "1d10t! ЅCUM"), (1002, "")]
    found = scores(documents, fitted, texts)
    for i, text in texts:
        assert abs(found[i] - (plain_score(fitted, text) if text else found[1002])) < 1e-12
