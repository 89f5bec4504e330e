from loomspark.llm.hidden_duplicates import collapsed, hidden_duplicates, json_members

SCHEMA = "row_id bigint, source_id string, prompt string, pairs string, fp1 string, id string"


def rows(spark, *triples):
    return spark.createDataFrame([(*t, "x", "y", "z") for t in triples], SCHEMA)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_formatting_is_ignored_and_symbols_count(spark):
    df = rows(
        spark,
        (1, "A-1", "What is 2 + 3?"), (2, " a1 ", "what  IS (2+3)"), (3, "a1", "what is 2 3"), (4, "a2", "What is 2 + 3?"),
        (5, "a1", "Straße"), (6, "A1", "STRASSE"), (7, "a1", "wh-at is 2+3　"),
    )
    assert pairs(hidden_duplicates(df)) == [(1, 2), (1, 7), (5, 6)]


def test_json_members_in_any_order_also_nested(spark):
    df = rows(
        spark,
        (1, "s", '{"q": "Hello, world", "limit": 12, "o": {"a": 1, "b": [1, 2]}}'), (2, "s", ' {"LIMIT":12,"o":{"b":[1,2],"a":1},"Q":"hello world"}'),
        (3, "s", '{"q": "Hello, world", "limit": 12, "o": {"a": 1, "b": [2, 1]}}'), (4, "s", '{"a": "x", "a": "x", "b": "y"}'), (5, "s", '{"a": "x", "b": "y", "b": "y"}'),
        (6, "s", '{"b": "y", "a": "x", "a": "x"}'), (7, "s", "{not json}"), (8, "s", "{ NOT json }"), (9, "s", "{}"), (10, "s", "{ }"),
    )
    assert pairs(hidden_duplicates(df)) == [(1, 2), (4, 6), (7, 8)]


def test_nulls_blanks_repeats_and_empty(spark):
    df = rows(spark, (1, None, "same"), (2, None, "same"), (3, "s", None), (4, "s", None), (5, "s", " ?! "), (6, "s", "?!"), (7, "s", "same"), (7, "s", "same"), (8, "s", "SAME"), (None, "s", "same"))
    assert pairs(hidden_duplicates(df)) == [(7, 8)]
    assert pairs(hidden_duplicates(df.limit(0))) == []
    assert pairs(collapsed(df)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2)]


def test_hot_group_and_long_text(spark, monkeypatch):
    import loomspark.llm.hidden_duplicates as m

    monkeypatch.setattr(m, "COPIES_PER_REPLICA", 7)
    monkeypatch.setattr(m, "HOT_GROUP", 10)
    long = "word " * 50_000
    df = rows(spark, *[(i, "s", long if i % 3 == 0 else f"other {i}") for i in range(120)])
    assert pairs(m.hidden_duplicates(df)) == [(0, i) for i in range(3, 120, 3)]


def test_members():
    assert json_members("[1]") is None and json_members(None) is None and json_members('{"a": ' * 100_000) is None
    assert json_members('{"a": 1.50, "b": true, "c": null}') == ["A\x1f150\x1f1", "B\x1ftrue\x1f1", "C\x1fnull\x1f1"]
