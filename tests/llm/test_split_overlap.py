import random

import numpy as np

from loomspark.llm.rolling import WordCodes, coded_texts, rolling, rolling_of
from loomspark.llm.split_overlap import choose_rarest, overlap_report, prefixes, split_overlaps, within

SCHEMA = "sample_id string, split string, prompt string, source string, key string, words string, n int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_within_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        k = rng.randint(0, 6)
        assert within(a, b, k) == (distance(a, b) <= k)


def cheapest(costs, q, need):
    """The smallest sum of costs of `need` disjoint shingles, one text at a time."""
    n = len(costs) + q - 1
    best = [[0] + [float("inf")] * need]
    for i in range(1, n + 1):
        row = list(best[-1])
        if i >= q:
            for c in range(1, need + 1):
                row[c] = min(row[c], best[i - q][c - 1] + costs[i - q])
        best.append(row)
    return best[n][need]


def test_chosen_shingles_are_disjoint_and_cheapest():
    rng = np.random.default_rng(0)
    for n in range(5, 60):
        q = 4 if n >= 20 else 3 if n >= 10 else 2
        need = n // 5 + 1
        costs = rng.integers(0, 9, (3, n - q + 1)).astype(float)
        for own, got in zip(costs, choose_rarest(costs, q, need).tolist()):
            assert len(got) == need and all(b - a >= q for a, b in zip(got, got[1:])) and got[-1] + q <= n
            assert own[got].sum() == cheapest(own.tolist(), q, need)


def test_prefixes_of_long_texts_are_rare_and_disjoint():
    rng = np.random.default_rng(1)
    sizes = [20, 999, 1001, 12_345, 7, 999]
    costs = [rng.integers(1, 1000, n - (3 if n >= 20 else 1)).astype(float) for n in sizes]
    for n, c, got in zip(sizes, costs, prefixes(costs, sizes)):
        q = 4 if n >= 20 else 2
        got = got.tolist()
        assert len(got) == n // 5 + 1 and all(b - a >= q for a, b in zip(sorted(got), sorted(got)[1:])) and max(got) + q <= n
        assert list(c[got]) == sorted(c[got]) and (n < 999 or c[got].mean() < 300)


def test_runs_of_many_texts_at_once():
    texts = ["a b c d e", "f", "a b c", "b c d e f g a b c"]
    coded = WordCodes()
    codes, sizes = coded_texts(texts, coded)
    for q in (1, 2, 3, 4):
        wanted = np.array([True, True, False, True])
        got = [(int(h), int(r), int(p)) for h, r, p in zip(*rolling_of(codes, sizes, wanted, q))]
        assert got == [(int(h), r, p) for r in (0, 1, 3) for p, h in enumerate(rolling(coded(texts[r].split(" ")), q))]


def test_heat_and_size_do_not_matter(spark, monkeypatch):
    import loomspark.llm.split_overlap as m

    rng = random.Random(9)
    stock = [f"s{i}" for i in range(12)]
    rows = [(f"id{i:03d}", "val" if i % 4 == 0 else "sft", " ".join(stock + [f"x{rng.randrange(3)}" for _ in range(rng.randint(0, 6))]), "s", "k", "w", 1) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, m.split_overlaps(df).collect()))
    monkeypatch.setattr(m, "SHINGLES_PER_PART", 7)
    monkeypatch.setattr(m, "FEW_ROWS", 0)
    assert len(want) > 100 and sorted(map(tuple, m.split_overlaps(df).collect())) == want


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, len(w) // 5)):
            p = rng.randrange(len(w) + 1)
            w[p : p + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocabulary)]])
        sep = rng.choice([" ", ", ", "\n"])
        rows.append((f"id{i:03d}", rng.choice(["val", "test", "sft", "opd"]), sep.join(w).upper() if i % 4 == 0 else sep.join(w)))
    df = spark.createDataFrame([(*r, "s", "k", "w", 1) for r in rows], SCHEMA)
    got = {(r.eval_id, r.train_id) for r in split_overlaps(df).collect()}
    import re

    split = {i: (s, re.findall(r"[^\W_]+", p.lower())) for i, s, p in rows}
    want = {(a, b) for a, (s, x) in split.items() for b, (t, y) in split.items() if s in ("val", "test") and t in ("sft", "opd") and x and y and distance(x, y) <= max(len(x), len(y)) // 6}
    assert got == want


def test_nulls_repeats_hot_text_and_empty(spark, monkeypatch):
    import loomspark.llm.split_overlap as m

    monkeypatch.setattr(m, "RECORDS_PER_PART", 3)
    rows = [("v1", " VAL ", "the same few words here", "a"), ("v1", "val", "the same few words here", "a"), ("v2", "test", None, "a"), ("v3", "test", " ", "a"), (None, "val", "the same few words here", "a")]
    rows += [(f"t{i}", "sft", "The same few words, here", "b") for i in range(10)] + [("t99", "opd", "", None), ("t98", "opd", None, None), ("x", None, "the same few words here", "c")]
    df = spark.createDataFrame([(*r, "k", "w", 1) for r in rows], SCHEMA)
    got = sorted((r.eval_id, r.train_id) for r in m.split_overlaps(df).collect())
    assert got == sorted(("v1", f"t{i}") for i in range(10))
    report = overlap_report(df, m.split_overlaps(df)).collect()
    assert [(r.eval_split, r.train_split, r.source, r.n_pairs, r.n_eval_records) for r in report] == [("val", "sft", "a", 10, 1)]
    assert m.split_overlaps(df.limit(0)).count() == 0
    assert m.split_overlaps(df.filter("split = 'sft'")).count() == 0
