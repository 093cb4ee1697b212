"""Answers of more words than 40, told by words that stand anywhere in them."""

import random

import pytest

from statuta.llm import pairs
from test_texts import ANSWERS, Q, logged

POLITE = "Thank you for the question about how the planum and the registra are kept at the office. You ask when this must be done and by whom, and I see why this is of interest to you."
ADVICE = "A lawyer can look at your case and advise you. The authority of your country publishes guidance on the system. It may help to read the act with its annexes."


@pytest.fixture(scope="module")
def model():
    c = pairs.Classifier()
    rows = logged(random.Random(1), 1500)
    c.language.train([x for r in rows for x in r])
    return c.train(pairs.examples(rows, c.language))


@pytest.mark.parametrize("refusal", ["I must decline to comment on this matter.", "I cannot give legal advice."])
def test_long_refusals(model, refusal):
    assert len(f"{POLITE} {refusal}".split()) > 40
    assert model.defect(Q, f"{POLITE} {refusal}") == "refusal"
    assert model.defect(Q, f"{POLITE} {refusal} {ADVICE}") == "refusal"


def test_long_answers_with_the_same_words_around_are_sound(model):
    a = " ".join(ANSWERS["en"].format(a=x, b="modula") for x in ("testora", "planum", "normata"))
    assert model.defect(Q, a) is None and model.defect(Q, f"{a} {ADVICE}") is None


def test_no_feature_is_lost_at_any_length(model):
    """The words at the end of an answer are features however many stand before them."""
    for n in (39, 40, 41, 400):
        a = "word " * n
        new = set(pairs.features(Q, a + "zzyx.", model.language).tolist()) - set(pairs.features(Q, a + "other.", model.language).tolist())
        assert pairs._h("uzzyx", pairs.BITS) + (1 << pairs.BITS) in new
