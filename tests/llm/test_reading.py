import random

import numpy as np

from loomspark.llm import langid
from loomspark.llm.reading import DocumentModel, english_prose, fit_logistic, reading_levels, sentences

LEVELS = {
    1: ["The cat sees the red ball.", "I like the big cup.", "Look at the small dog.", "We put the bag in the box."],
    2: ["The diagram shows how one solution reduces the pressure.", "Students often compare the result with another useful table.", "Because the function changes, the value stays stable."],
    3: ["Suppose that the invertible operator partitions every continuous sequence, so that the associated kernel converges.", "It follows that any orthogonal projection which satisfies the condition remains bounded by the spectrum."],
    4: ["Insofar as the epiphenomenal dimensionality presupposes the metastable axiom from which its own normativity was inferred, any ostensibly coherent account remains contingent upon assumptions.", "Whereas earlier treatments conflated heterogeneity with interdependence, albeit paradoxically, the present formulation undermines conventional taxonomies."],
}
DE = "Die Regel beschreibt das Ergebnis und der Text bleibt gleich. Wir sehen, dass die Zahl den Versuch bestimmt. "


def document(rng, level):
    return "Notes 3\n\n" + " ".join(rng.choice(LEVELS[level]) for _ in range(16))


def test_prose_is_told_from_code_logs_and_headings():
    text = "# Title: one\n\n- First we look\n  at the big cup.\n\n```python\nx = 1\n```\nstep:4 - loss:0.12 - norm:3.4\n| a | b |\n<b>It</b> is so $x+1$ that we keep exam-\nple words here."
    found, other = sentences(text)
    assert [w for _, w in found] == ["first we look at the big cup".split(), "it is so that we keep example words here".split()]
    assert other > 5
    assert sentences(None) == ([], 0) and sentences("") == ([], 0) and len(sentences("a b c d e. " * 100_000)[0]) == 100_000


def test_logistic_learns_and_held_out_accuracy():
    rng = random.Random(4)
    x = np.random.default_rng(0).normal(size=(200, 3))
    y = (x[:, 0] > 0).astype(int)
    w = fit_logistic(x, y, np.ones(200), 1e-3)
    assert ((x @ w).argmax(axis=1) == y).mean() > 0.95
    data = [(sentences(document(rng, k))[0], k) for k in LEVELS for _ in range(12)]
    model = DocumentModel(data)
    test = [(sentences(document(rng, k))[0], k) for k in LEVELS for _ in range(10)]
    assert np.mean([a == b for a, b in zip(model.levels([d for d, _ in test]), [k for _, k in test])]) > 0.9


def test_foreign_sentences_leave():
    rng = random.Random(1)
    lm = langid.LanguageModel([("en", document(rng, k)) for k in LEVELS for _ in range(4)] + [("de", DE * 4)] * 6)
    doc = sentences(document(rng, 1) + " " + DE)[0]
    assert len(english_prose([doc], lm)[0]) == 16


def test_frame(spark):
    rng = random.Random(2)
    rows = [(i, document(rng, 1 + i % 4), "en", 7) for i in range(80)] + [(i, DE * 12, "de", 7) for i in range(100, 120)]
    rows += [(200, None, "en", 7), (201, "", "en", 7), (202, "The cat sees it.", "en", 7), (203, DE * 9, "en", 7), (204, "```\n" + "x = 1\n" * 500 + "```\n" + document(rng, 1), "en", 7), (205, document(rng, 2) * 300, None, 7), (0, rows[0][1], "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, level int")
    labels = spark.createDataFrame([(i, 1 + i % 4, "r", 7) for i in range(48)] + [(0, 2, "q", 7), (None, 1, "q", 7), (5, None, "q", 7)], "doc_id bigint, reading_level int, rater string, level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, labels).collect()}
    assert set(got) == {*range(80), 205} and got[205] == 2
    assert np.mean([got[i] == 1 + i % 4 for i in range(48, 80)]) > 0.9
    assert reading_levels(docs.limit(0), labels).count() == 0
    assert reading_levels(docs, labels.limit(0)).count() == 0


def test_english_prose_beside_more_of_another_language(spark):
    """60 English words have a level, though the German ones around them are more."""
    rng = random.Random(3)
    rows = [(i, document(rng, 1 + i % 4), "en") for i in range(48)] + [(i, DE * 12, "de") for i in range(100, 120)]
    english = " ".join(LEVELS[1][i % 4] for i in range(10))
    rows += [(300, f"{english}\n\n{DE * 6}", "de"), (301, f"{english[:60]}\n\n{DE * 6}", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1 + i % 4) for i in range(48)], "doc_id bigint, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, labels).collect()}
    assert set(got) == {*range(48), 300} and got[300] == 1
