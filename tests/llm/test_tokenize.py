import random

import pytest

from loomspark.llm.tokenize import DEFAULT_VOCABULARY, Encoder, encode_corpus

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(encoder, texts):
    offsets, ids = encoder.encode(texts)
    return [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))]


def test_equals_the_library_on_odd_texts(reference):
    rng = random.Random(3)
    alphabets = ["abcdeéß日 \n\t's0123.,", "aab", "<|endoftext|> ", "‍👨👩👧 x", "'re'll I'd", " 　 \r\n"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 7, 40, 400)] + ["", "<|endoftext|>", "a" * 5000, "ab" * 2000]
    assert split(Encoder(), texts) == reference(texts)


def test_round_trip_after_the_memory_is_full(reference, monkeypatch):
    import loomspark.llm.tokenize as m

    monkeypatch.setattr(m, "REMEMBERED", 3)
    e = Encoder()
    texts = ["one two three four", "five six", "one two"]
    assert [split(e, [t])[0] for t in texts] == reference(texts)


def test_null_empty_repeated_and_clashing_columns(spark, reference):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, None, 1), (3, "", 2), (None, "x", 3)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode_corpus(df, block_chars=3).collect()), key=str)
    ab, x = reference(["a b", "x"])
    assert got == sorted([(1, ab), (1, ab), (2, []), (3, []), (None, x)], key=str)
    assert encode_corpus(df.limit(0)).count() == 0
