import random

from loomspark.llm.mixture import Flow, Target, draw_mixture, floor_product, mixture_report, quotas, solve, unmet_targets

POOL = "sample_id string, split string, domain string, difficulty string, topic string, c_split string, l string"
TARGETS = "target_id bigint, plan_name string, split string, sample_fraction double, domain string, difficulty string, topic string, target_share double, min_rows int"


def pool(spark, n=200):
    rows = []
    for i in range(n):
        domain = ["Math", " math", "CODE", "code"][i % 4] if i % 10 else None
        rows.append((f"s{i:04d}", "sft", domain, ["easy", "EASY ", "very_hard", "Very-Hard"][i % 4], f"t{i % 3}", "a", "b"))
    return spark.createDataFrame(rows + rows[:7] + [(None, "sft", "math", "easy", "t0", "a", "b"), ("o1", "opd", "math", None, None, "a", "b")], POOL)


def targets(spark, *rows):
    return spark.createDataFrame(list(rows), TARGETS)


def test_flow_is_cheapest():
    f = Flow()
    a = f.arc(0, 2, 5, 2)
    b = f.arc(0, 3, 5, 4)
    f.arc(2, 1, 3, 0)
    f.arc(3, 1, 9, 0)
    f.arc(2, 3, 9, 1)
    f.run(0, 1)
    assert (f.used(a), f.used(b)) == (5, 5)


def most(targets, cells, asked):
    """The most rows that any draw can give, by augmenting paths one row at a time."""
    left, holds, total = dict(cells), {}, 0

    def place(t, seen):
        for c in cells:
            if c in seen or not t.matches(c):
                continue
            seen.add(c)
            if left[c]:
                left[c] -= 1
                holds[c, t.target_id] = holds.get((c, t.target_id), 0) + 1
                return True
            for u in targets:
                if u is not t and holds.get((c, u.target_id)) and place(u, seen):
                    holds[c, u.target_id] -= 1
                    holds[c, t.target_id] = holds.get((c, t.target_id), 0) + 1
                    return True
        return False

    for t in targets:
        for _ in range(asked[t.target_id]):
            total += place(t, set())
    return total


def test_no_false_shortfall():
    """Rows that exist are drawn, whatever the random prices and however long the chain of targets that must move over."""
    rng = random.Random(3)
    two = [Target(1, "p", "s", ("a", None), 0.5, 0, 10, 20), Target(2, "p", "s", (None, "x"), 0.5, 0, 10, 20)]
    cells = {("a", "x"): 10, ("a", "y"): 5, ("b", "x"): 5}
    for seed in range(200):
        missing, taken = solve(two, cells, {1: 10, 2: 10}, str(seed))
        assert not any(missing.values()) and sum(taken.values()) == 20
    for n in (25, 60):
        chain = [Target(i, "p", "s", (None, None), 0.0, 0, 5, 5 * n) for i in range(n)]
        for i, t in enumerate(chain):
            t.matches = lambda c, i=i: c[0] in (f"{i:03d}", f"{i + 1:03d}")
        cells = {(f"{i:03d}", ""): 5 for i in range(1, n + 1)}
        assert not any(solve(chain, cells, {i: 5 for i in range(n)}, "s")[0].values())
    for k in range(60):
        targets = [Target(i, "p", "s", tuple(rng.choice([None, "a", "b", "c"]) for _ in range(2)), 0.0, rng.randint(0, 3), 0, 0) for i in range(5)]
        cells = {(x, y): rng.randint(0, 6) for x in "abc" for y in "abc"}
        asked = {t.target_id: t.floor + rng.randint(0, 9) for t in targets}
        missing, taken = solve(targets, cells, asked, str(k))
        assert sum(taken.values()) == sum(asked.values()) - sum(missing.values()) == most(targets, cells, asked)
        assert all(sum(n for (_, d), n in taken.items() if d == c) <= cells[c] for c in cells)


def test_floors_stay_within_the_rows_of_the_plan():
    targets = [Target(1, "p", "s", ("a",), 0.98, 10, 98, 100), Target(2, "p", "s", ("b",), 0.01, 10, 10, 100), Target(3, "p", "s", ("c",), 0.01, 10, 10, 100)]
    asked = quotas(targets, 100, "x")
    assert asked == {1: 80, 2: 10, 3: 10}
    assert quotas(targets, 20, "x") == {1: 10, 2: 10, 3: 10}  # the floors alone exceed the plan
    thirds = [Target(i, "p", "s", (str(i),), 1 / 3, 0, 33, 100) for i in range(3)]
    assert {sum(quotas(thirds, 100, str(s)).values()) for s in range(20)} == {100} and len({tuple(quotas(thirds, 100, str(s)).items()) for s in range(20)}) == 3
    # A floor comes before the shares of others, where rows do not suffice for both.
    pair = [Target(1, "p", "s", (None,), 0.9, 0, 9, 10), Target(2, "p", "s", ("a",), 0.1, 4, 4, 10)]
    missing, _ = solve(pair, {("a",): 5}, {1: 6, 2: 4}, "x")
    assert missing == {1: 5, 2: 0}


def test_floor_of_decimal_shares():
    assert floor_product(0.29, 100) == 29 and floor_product(0.3, 10) == 3 and floor_product(0.25, 7) == 1


def test_unmet_counts_distinct_records_by_folded_labels(spark):
    t = targets(spark, (1, "p", "sft", 0.5, "MATH", None, None, 0.8, 1), (2, "p", "sft", 0.5, "math", "Very Hard", None, 0.0, 1), (3, "p", "sft", 0.5, None, None, None, 0.1, 1), (4, "q", "opd", 1.0, "math", "easy", None, 1.0, 1), (5, "q", "val", 1.0, "math", None, None, 1.0, 2), (6, "q", "val", 1.0, "math", None, None, 1.0, 0))
    # sft: 200 records, 100 drawn; math: 90 of them with a domain; none of the math ones is very hard
    assert sorted(r.target_id for r in unmet_targets(pool(spark), t).collect()) == [2, 4, 5]


def test_sample_meets_quotas_once_and_repeats(spark):
    t = targets(spark, (1, "p", "sft", 0.35, "math", "easy", None, 0.5, 1), (2, "p", "sft", 0.35, "code", None, "t1", 0.25, 29), (3, "p", "sft", 0.35, None, None, "t2", 0.25, 1))
    p = pool(spark)
    drawn = draw_mixture(p, t, "x").collect()
    assert len({r.sample_id for r in drawn}) == len(drawn)
    report = {r.target_id: r for r in mixture_report(p, t, "x").collect()}
    for k, r in report.items():
        assert sum(d.target_id == k for d in drawn) == r.drawn == r.asked - r.shortfall
    assert report[1].need == 35 and report[2].asked == 29 and report[2].shortfall == 0 and sum(r.asked for r in report.values()) == 70
    assert sorted(drawn) == sorted(draw_mixture(p.repartition(7), t, "x").collect())
    assert sorted(drawn) != sorted(draw_mixture(p, t, "y").collect())


def test_empty_tables(spark):
    t = targets(spark, (1, "p", "sft", 0.5, "math", None, None, 1.0, 3), (2, "p", "sft", 0.5, "code", None, None, 0.0, 0))
    empty = pool(spark).limit(0)
    assert [r.target_id for r in unmet_targets(empty, t).collect()] == [1]
    assert draw_mixture(empty, t).count() == 0
    assert unmet_targets(pool(spark), t.limit(0)).count() == 0


def test_plan_in_two_splits(spark):
    t = targets(spark, (1, "p", "sft", 0.5, "math", None, None, 1.0, 0), (2, "p", "opd", 1.0, "math", None, None, 1.0, 0))
    drawn = draw_mixture(pool(spark), t).collect()
    assert [r.sample_id for r in drawn if r.target_id == 2] == ["o1"] and sum(r.target_id == 1 for r in drawn) == 90
