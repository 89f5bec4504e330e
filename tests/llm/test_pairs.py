import pytest

from loomspark.llm import langid
from loomspark.llm.pairs import SLOTS, EndingModel, Judge, broken_pairs, ending_counts, is_copy, is_empty, is_open, is_refusal, slot_of, with_likelihood

EN = "The diagram shows how one value follows the other. It is so that the second number changes. We look at the result of each step with care. "
DE = "Die Regel beschreibt das Ergebnis und der Text bleibt gleich. Wir sehen, dass die Zahl den Versuch bestimmt. Danach vergleicht der Rechner die Lösung. "
ASK = "Explain to me why this one thing is larger than that other thing and how you can tell when it is. "
FRAGE = "Warum ist diese Sache größer als jene und woran kann man das erkennen, wenn es so ist? "
FR = "Le modèle explique la suite parce que la règle demande des étapes. Nous voyons que le texte vérifie la preuve. Ensuite la valeur change le calcul. "


@pytest.fixture(scope="module")
def judge():
    languages = langid.LanguageModel([("en", EN * 3 + ASK), ("de", DE * 3 + FRAGE), ("fr", FR * 3)] * 5)
    return Judge(languages, EndingModel([EN * 2, DE, FR] * 20))


def one(judge, q, a, there=True, flagged=False):
    return judge.defects([(q, a, there, flagged)])[0]


def test_empty(judge):
    for a in (None, "", "  \n", "N/A", "null", "...", "-", "```\n```", "\\boxed{}", "<p></p>", "<think>long thought</think>  ", "<|endoftext|>"):
        assert one(judge, "What?", a) == "empty", a
    assert one(judge, "What?", None, there=False) == "empty"
    assert not is_empty("\\boxed{7}") and not is_empty("No.") and not is_empty("42")


def test_truncated(judge):
    for a in ("<think>and so", EN + "It is so that the second num", EN + "We look at the", "So $x = 3 + ", "```python\nx = 1\n", "| a | b |\n|---|---|\n| 1 |", "- one thing\n-", "So \\frac{1}{", "\\begin{align} x &= 1 \\\\", "**Step 4:"):
        assert one(judge, ASK, a) == "truncated", a
    for a in (EN, EN.rstrip(". "), "- first thing\n- second thing.", "```python\nx = 1\n```", "Here is the code:\n```python\nx = 1\n```", "The result is \\boxed{3}", "| a | b |\n|---|---|\n| 1 | 2 |"):
        assert one(judge, ASK, a) is None, a
    assert not is_open("costs \\$5 and $x$.")


def test_refusal(judge):
    for a in ("I'm sorry, but I can't help with this request.", "I must decline to answer. Please ask me something else.", "Leider darf ich diese Frage nicht beantworten.", "Pardon, je dois refuser cette tâche.", "Disculpa, no puedo ayudar."):
        assert one(judge, ASK, a) == "refusal", a
    assert not is_refusal("I cannot stress enough that the order matters. " + EN * 3)
    assert not is_refusal("We are not allowed to divide by zero here. " + EN * 3)
    for a in (
        "To find x we need to solve x + 1 = 2. So x is 1.", "You have to provide both sides with 2, giving x = 4.", "We must answer with a single letter, so it is B.", "First we need to complete this square. Then x is 2.",
        "分母不能为零，所以答案是三。", "Es ist nicht möglich, dass x negativ ist. Also ist x gleich 3.", "The cat will not help here, so the answer is 4.", "No se puede dividir por cero, luego la respuesta es 3.", "I can't solve this by factoring. Completing the square gives \\boxed{3}.",
        "On ne peut pas diviser par zéro. Donc la réponse est trois.", "Нельзя делить на ноль, поэтому ответ три.", "You must refuse the second root, so x is 3.",
    ):
        assert not is_refusal(a), a
    for a in ("抱歉，我无法回答这个问题。", "Ich kann Ihnen dabei leider nicht weiterhelfen.", "Я не могу помочь с этим запросом.", "申し訳ありませんが、その質問にはお答えできません。", "This is outside of what I'm allowed to discuss. I hope you understand."):
        assert is_refusal(a), a


def test_copied():
    q = "Consider the blue puzzle where the stone wants the bird. Compute the sum of all parts in order."
    assert is_copy(q, q) and is_copy(q, f"Question: {q.upper()}") and is_copy(q, f"{q} {q}") and is_copy(q, q.replace("bird", "cat"))
    assert not is_copy(q, f"{q}\n\nWe add the parts one after the other and then check that nothing is left over.")
    assert not is_copy(q, f"{q} \\boxed{{12}}") and not is_copy(q, "") and not is_copy("", q)


def test_other_language(judge):
    assert one(judge, ASK, DE) == "other_language" and one(judge, FRAGE, FR) == "other_language" and one(judge, ASK, "Мы видим, что модуль часто улучшает ответ. Затем список меняет график.") == "other_language"
    assert one(judge, ASK + "Please write in German.", DE) is None and one(judge, FRAGE, DE) is None
    assert one(judge, ASK, EN + f'"{DE[:60]}."') is None


def test_frame(spark):
    schema = "response_id bigint, messages array<struct<role:string,content:string>>, teacher_finish_reason string, teacher_truncated boolean, turn int"
    rows = [
        (1, [("system", "s"), (" USER", ASK), ("Assistant ", EN)], "stop", False, 5), (2, [("user", EN)], None, None, 5), (2, [("user", EN)], None, None, 5), (3, None, None, None, 5), (4, [], None, None, 5),
        (5, [("user", EN), ("user", None), ("assistant", None)], None, None, 5), (6, [("user", ASK), ("assistant", EN * 2000), ("user", ASK), ("assistant", DE)], "length", True, 5), (None, [("user", EN)], None, None, 5),
    ]
    df = spark.createDataFrame(rows, schema)
    labelled = spark.createDataFrame([(i, t, x) for i in range(30) for t, x in ((EN * 2 + ASK, "en-US"), (DE * 2 + FRAGE, "DE"), (FR * 2, "french"), (None, "en"), ("x", None))], "doc_id bigint, text string, lang string")
    got = sorted(map(tuple, broken_pairs(df, labelled).collect()))
    assert got == [(2, 0, "empty"), (5, 0, "empty"), (5, 1, "empty"), (6, 2, "other_language")]
    assert broken_pairs(df.limit(0), labelled).count() == 0
    assert broken_pairs(df, labelled.limit(0)).count() >= 3


def test_endings_of_all_rows(spark):
    """A last word that only one response holds elsewhere is known, however few rows the models are fitted on."""
    schema = "response_id bigint, messages array<struct<role:string,content:string>>, teacher_finish_reason string, teacher_truncated boolean"
    names = ["Quorvex", "Blimtha", "Zandrup", "Wexholm", "Pyrgosk", "Ulfbrin", "Jastovy", "Nedquil"]
    texts = [EN + f"The value is due to {n}." for n in names] + [EN + f"The value is due to {n}" for n in names] + [EN + "The value is due to Quorv", "- one thing\n- due to Blimt", "- two things\n- due to Blimt"] + [EN + f"Sample {i} here." for i in range(60)]
    df = spark.createDataFrame([(i, [("user", ASK), ("assistant", t)], None, None) for i, t in enumerate(texts)], schema)
    labelled = spark.createDataFrame([(i, EN * 2 + ASK, "en") for i in range(9)], "doc_id bigint, text string, lang string")
    want = [(16, 0, "truncated"), (17, 0, "truncated"), (18, 0, "truncated")]
    assert sorted(map(tuple, broken_pairs(df, labelled, train_rows=5).collect())) == want
    assert sorted(map(tuple, broken_pairs(df.repartition(7), labelled).collect())) == want


def test_likelihood_of_tables(spark):
    """The tables give what the model in memory gives."""
    texts = [EN + "- a list item of things\n- the last item", DE, FR + "It is 12 or 13.", "The banana can span a wide plan."]
    model = EndingModel(texts)
    asked = [EndingModel.asked(x) for x in ("of each step with care", "We look at the", "of things", "the last item", "a bananan", "what replan", "some zan", "the cha", "a bana", "x", "about 99", "Der Text bleibt gleich", "the xyzzy")]
    bits = bytearray(SLOTS // 8)
    for a in asked:
        bits[slot_of(*a) >> 3] |= 1 << (slot_of(*a) & 7)
    rows = spark.createDataFrame([([("assistant", t)],) for t in texts], "messages array<struct<role:string,content:string>>")
    got = with_likelihood(spark.createDataFrame(asked, "before string, word string"), ending_counts(rows, bytes(bits)))
    assert {(r.before, r.word): r.likelihood for r in got.collect()} == {a: pytest.approx(model.likelihood(" ".join(a).replace("^", ""))) for a in asked}
