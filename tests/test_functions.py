"""Functions and operators on rows that the tables do not hold."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import product
from statistics import fmean, pstdev

import pytest
from pyspark.sql import functions as F

from loomspark.functions import checkers as ck
from loomspark.functions import grading, prompts, text
from loomspark.operators import batches, contamination, extractors, rollouts, sampling
from loomspark.plans import catalog, q_data, q_extract
from loomspark.sources import files, windows
from loomspark.streaming import monitor


def value(spark, column, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("t", "want"),
    [("so \\boxed{277}", "277"), ("\\boxed{\\frac{3}{4}}.", "\\frac{3}{4}"), ("\\boxed{1} then \\boxed{2\\sqrt{3}}", "2\\sqrt{3}"), ("\\fbox{5}", "5"), ("\\boxed{open", None), ("none", None), ("\\boxed{}", "")],
)
def test_boxed(spark, t, want):
    assert value(spark, text.boxed(F.lit(t))) == want


def test_answers(spark):
    assert value(spark, text.unwrap_answer(F.lit('["5"]'))) == "5"
    assert value(spark, text.unwrap_answer(F.lit("5"))) == "5"
    assert value(spark, text.normalize_number(F.lit(" $1,007 "))) == "1007" and value(spark, text.normalize_number(F.lit("-007"))) == "-7" and value(spark, text.normalize_number(F.lit("X1"))) == "x1"
    assert value(spark, text.final_letter(F.lit("maybe A, no: (C)."))) == "C" and value(spark, text.final_letter(F.lit("\\boxed{b} or D"))) == "B"
    assert value(spark, text.extract_code(F.lit("a ```python\nx=1\n``` b ```y``` c"))) == "y"


def test_splitting_words_knows_python_spaces(spark):
    t = " one\x85two　 three\x1cfour "
    assert value(spark, text.split_words(F.lit(t))) == t.split()
    assert value(spark, text.split_words(F.lit(" \t"))) == []
    assert value(spark, text.repetition_rate(text.split_words(F.lit("a b a b a b")), 2)) == pytest.approx(3 / 5)
    assert value(spark, text.repetition_rate(text.split_words(F.lit("a")), 2)) == 0.0


def test_reasoning(spark):
    t = "<think>why</think>answer </think> more"
    assert value(spark, text.reasoning(F.lit(t))) == "why" and value(spark, text.answer(F.lit(t))) == "answer </think> more"


BOX = "Put your final answer in \\boxed{}."


def test_strip_instructions(spark):
    strip = lambda t: value(spark, prompts.strip_column(F.lit(t)))
    for t in (f"What is 2+2?\n{BOX}", f"{BOX}\nWhat is 2+2?", f"What is 2+2? {BOX}", f"{BOX} What is 2+2?", f"{BOX}\n\nWhat is 2+2?\n\nProvide a precise and correct solution using your knowledge.", "What is 2+2?"):
        assert strip(t) == "What is 2+2?", t
    for t in (BOX, "The box \\boxed{42} is the answer: give x.", "", "See \\[x^2\\] and solve."):
        assert strip(t) == t
    assert strip(f"A b.\n{BOX}\nC d.\n\n\n\nE  f.") == "A b.\nC d.\nE f." and strip(" \n ") == "" and strip(None) is None
    assert len(strip("word " * 50_000)) == 249_999


def test_align_is_idempotent(spark):
    align = lambda t, d="math": value(spark, prompts.align_column(F.lit(t), F.lit(d)))
    for t in (f"What is 2+2? {BOX}", "What is $x^2$?", f"Find x.{prompts.BOXED_SUFFIX}{prompts.BOXED_SUFFIX}"):
        once = align(t)
        assert once.count("\\boxed{}") == 1 and align(once) == once
    assert align("Find x. ", "instruction_following") == "Find x." and align(None) is None
    with pytest.raises(Exception, match="suffix"):
        align("x", "code")


def test_code_prompt(spark):
    code = lambda t, start=None: value(spark, prompts.code_prompt_column(F.lit(t), F.lit(start).cast("string")))
    p = code(f"{prompts.HARNESS[0]}\n\n{prompts.HARNESS[1]}\nSort a list.", "def f(): pass")
    assert "### Question:\nSort a list.\n" in p and "def f(): pass" in p and prompts.WITH_STARTER in p
    assert prompts.WITHOUT_STARTER in code("Sort.") and code(None) is None


def test_competing(spark):
    assert value(spark, prompts.competing_count(F.lit("The answer is [X]. Answer: X" + prompts.BOXED_SUFFIX), F.lit("math"))) == 2


CITY = "ID,Country,City,Year,Count\n" + "1,a,b,2,3\n" * 7
STOCK = "ProductID,Category,Brand,Price,Stock\n" + "1,a,b,2,3\n" * 13
GRADES = "\n".join(["\t".join(f'"{x}"' for x in ck.STUDENT_HEADER)] + ['"1"\t"a b"\t"c"\t"d"\t"e"'] * 3)
QUIZ = "\n".join(f"Question {i}. Why {'so ' * i}?\n" + "\n".join(f"{c}. it" for c in "ABCDE") for i in (1, 2, 3, 4))
CHECKS = [
    (ck.csv_city, CITY, True), (ck.csv_city, CITY.replace("City", "Town"), False), (ck.csv_city, "a,b,c,d,e\n" + CITY[26:], False), (ck.csv_city, CITY + "\n", False), (ck.csv_special_character, STOCK + '1,"a#",b,2,3', True), (ck.csv_special_character, STOCK + "1,a,b,2,3", False),
    (ck.csv_special_character, STOCK.replace("1,a,b,2,3\n", "1,a,b\n", 1) + '1,"a#",b,2,3', False), (ck.csv_quotes, GRADES, True), (ck.csv_quotes, GRADES.replace('"e"', "e"), False), (ck.csv_quotes, GRADES.replace("\t", ","), False),
    (ck.nested_quotes, "'a \"b 'c' d", False), (lambda t: ck.option_response(t, ["itsyes no"], False), "it's-yes no", False), (lambda t: ck.option_response(t, ["it's-yes no"], False), "(It's-YES no).", True),
    (ck.growing_alliteration, "One thing. Big bears run. Big bears bite two toads.", True), (ck.growing_alliteration, "Big bears. Two toads.", False), (ck.title_case, "A Big-Cat iPhone", True), (ck.title_case, "A big Cat", False), (ck.some_bullets, "A b. C d.\n\n* e\n* f", True), (ck.some_bullets, "A b.\n\nC d.\n* e\n* f", False), (ck.some_bullets, "A b. C d.\n* e\nx\n* f", False),
    (ck.growing_questions, QUIZ, True), (ck.growing_questions, "Hi. " + QUIZ, False), (ck.growing_questions, QUIZ.replace("E. it", "it", 1), False), (ck.capitals_sorted, ",".join(ck.CAPITALS), True), (ck.capitals_sorted, ",".join(ck.CAPITALS[::-1]), False), (ck.countries_backwards, "Zimbabwe\n" + "x\n" * 60, False),
    (lambda t: ck.pronouns(t, 3), "she/her/hers", True), (lambda t: ck.stop_word_share(t, 50), "the cat", True), (lambda t: ck.stop_word_share(t, 49), "the cat", False), (ck.ends_with_emoji, "Yes 😀. No!", False), (ck.ends_with_emoji, "Yes. 😀 No 🎉!", True), (lambda t: ck.keyword_at(t, "cat", 2, 3), "A. See, the CAT now.", True), (lambda t: ck.words_at_both_ends(t, "x"), "a x b x c!", True), (ck.reversed_sentence, "Flies eagle bald the!", True),
    (ck.nested_parentheses, "a ([{(())}]) b", True), (ck.nested_parentheses, "((((a))))", False), (ck.alphabet_loop, "zebra ate berries", True), (ck.alphabet_loop, "a c", False),
    (ck.prime_lengths, "is the", True), (ck.prime_lengths, "four", False), (ck.multiples, "14, 21, 28, 35, 42, 49", True), (ck.reversed_phrase, "elgae dlab", True), (ck.punctuation_cover, "a. b, c! d? e; f: g!?", True),
    (ck.date_list, "1800-02-29, 1769-12-31", True), (ck.date_list, "1800-02-30", False), (ck.italics_thesis, "<i>x</i> more", True), (ck.italics_thesis, "<i> </i> more", False), (ck.no_whitespace, "a　b", False),
    (ck.quote_explained, 'He said "x" and left.', True), (ck.quote_explained, '"a" "b" c', False), (ck.sub_bullets, "* a - b * c - d", True), (ck.sub_bullets, "* a * b - c", False), (ck.paragraph_first_last, "go on go\nno", True),
    (ck.no_consecutive_initials, "a b a", True), (ck.no_consecutive_initials, "a b bb", False), (ck.nested_quotes, "'a \"b 'c' d\" e'", True), (ck.nested_quotes, "'a' \"b\"", False), (ck.indent_stairs, "a\n b\n\n  c", True), (ck.indent_stairs, "a\nb", False),
    (ck.sentence_type_ratio, "A b. C d. E f?", True), (ck.last_first, "I go. Go on.", True), (ck.output_template, "My Answer: a My Conclusion: b Future Outlook: c", True), (ck.consonant_clusters, "strong words", True), (ck.few_vowels, "a test", True),
    (lambda t: ck.word_repeats(t, 1), "a A", False), (lambda t: ck.growing_sentences(t, 1), "A b. A b c.", True), (lambda t: ck.keyword_counts(t, ["a1", "b1", "c1", "d1", "e1"]), "a1 b1 b1 c1 c1 c1 " + "d1 " * 5 + "e1 " * 7, True),
    (lambda t: ck.option_response(t, ["Yes", "No"], False), " yes. ", True), (lambda t: ck.option_response(t, ["Yes", "No"], True), "yes", False), (lambda t: ck.person_names(t, 2), "Emma met Leo", True),
    (lambda t: ck.repeat_changed(t, F.lit("say it again")), "tell it again", True), (lambda t: ck.marker_list(t, "!!"), "!!a !!b", True), (lambda t: ck.nth_word_japanese(t, 2), "a 日 b 3", True), (lambda t: ck.keyword_in_sentence(t, "cat", 2), "A b. The cat.", True),
]


def test_checkers(spark):
    row = spark.range(1).select(*[check(F.lit(t)).alias(f"c{i}") for i, (check, t, _) in enumerate(CHECKS)]).first()
    assert [row[i] for i in range(len(CHECKS))] == [w for _, _, w in CHECKS]


def test_trigram_overlap(spark):
    over = lambda t, p: value(spark, ck.trigram_overlap(F.lit(t), F.lit("abcdx"), p))
    assert over("abcd", 100) and over("abce", 50) and not over("abce", 60) and over("ab", 0) and over("zzzz", 0)


def test_strict_and_loose(spark):
    check = lambda t: t.startswith("b")
    assert value(spark, ck.loose(F.lit("a\nb\nc"), check)) and not value(spark, ck.strict(F.lit("a\nb\nc"), check))
    assert not value(spark, ck.strict(F.lit("  "), lambda t: F.lit(True)))


def test_graders(spark):
    assert value(spark, grading.hash_answer(F.lit("x #### 1,234"))) == "1234"
    assert value(spark, grading.last_number(F.lit("a 3 b 4.5 ."))) == "4.5"
    assert value(spark, grading.minerva_reward(F.lit("Answer: $\\frac12$"), F.lit("\\frac{1}{2}"))) == 1.0
    assert value(spark, grading.minerva_reward(F.lit("no line"), F.lit("1"))) == -1.0
    forms = {"\\dfrac12": "\\frac{1}{2}", "1/2": "\\frac{1}{2}", "x=0.5": "\\frac{1}{2}", "\\sqrt2": "\\sqrt{2}", ".5": "\\frac{1}{2}", "abc = 3": "abc=3", "3 \\text{ cm}": "3", "\\frac1{72}": "\\frac{1}{72}", "": ""}
    assert {x: value(spark, grading.canonical_math(F.lit(x))) for x in forms} == forms
    assert not value(spark, grading.math_equal(F.lit(None).cast("string"), F.lit("1")))
    with pytest.raises(Exception, match="no grader"):
        value(spark, grading.graded(F.lit("codecontests"), F.lit("x"), F.lit("y")))
    assert value(spark, grading.output_equal(F.lit("123456789012345678901234567890123456789.50"), F.lit("+123456789012345678901234567890123456789.5"))) and not value(spark, grading.output_equal(F.lit("1 x"), F.lit("1.0 x")))
    assert value(spark, grading.output_equal(F.lit("1.0 2\nx "), F.lit("1 2.00\nx"))) and not value(spark, grading.output_equal(F.lit("1\n2"), F.lit("1")))
    assert value(spark, grading.exact_match(F.lit("The  Cat!"), F.array(F.lit("dog"), F.lit("a cat"))))
    n, c = F.lit(2).cast("bigint"), F.lit(1).cast("bigint")
    assert value(spark, grading.pass_at_k(n, c, 1)) == 0.5 and value(spark, grading.pass_at_k(n, c, 2)) == 1.0


def test_contamination_branches(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    items = [("near", " ".join(words[:30])), ("short", "what does alphabetagamma owe deltaepsilon after sixty"), ("low", " ".join(words[10:40]))]
    b = spark.createDataFrame([(i, n, i, t) for i, (n, t) in enumerate(items)], "item_id bigint, benchmark string, benchmark_index int, text string")
    docs = [" ".join([*words[:28], "x", "y"]), "so: WHAT does alphabetagamma, owe deltaepsilon after sixty days", "alphabetagamma owe deltaepsilon after sixty", "", None, items[0][1].upper()]
    p = spark.createDataFrame(list(enumerate(docs)), "id bigint, t string")
    want = {(0, "near"): ("near_duplicate", round(16 / 20, 4)), (1, "short"): ("exact", 1.0), (5, "near"): ("exact", 1.0)}
    assert {(r.prompt_id, r.benchmark): (r.level, r.score) for r in contamination.contamination_matches(p, b, "id", "t").collect()} == want
    monkeypatch.setattr(contamination, "broadcast_if_few", lambda df: df)  # both sides shuffled, hot shingles in parts
    monkeypatch.setattr(contamination, "SALTS", 1)
    assert {(r.prompt_id, r.benchmark): (r.level, r.score) for r in contamination.contamination_matches(p, b, "id", "t").collect()} == want


def test_contamination_of_one_or_two_words(spark):
    one, two, half = "z" * 20 + "y" * 40, "a" * 40 + " " + "b" * 12, "c" * 6 + " " + "d" * 50
    b = spark.createDataFrame([(i, "x", i, t) for i, t in enumerate((one, two, half, "short words"))], "item_id bigint, benchmark string, benchmark_index int, text string")
    long = " ".join(f"w{i}" for i in range(20))
    docs = [f"{long} q{one}q {long}", f"{long} q{two}q {long}", f"{long} q{half}q {long}", long, f"{long} {two.split()[0]} x {two.split()[1]}", one[3:55], two[1:50], f"{one[:47]} {long}"]
    p = spark.createDataFrame(list(enumerate(docs)), "id bigint, t string")
    got = sorted((r.prompt_id, r.item_id) for r in contamination.contamination_matches(p, b, "id", "t").collect())
    assert got == [(0, 0), (1, 1), (2, 2), (5, 0), (6, 1)]


def test_sampling(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 9 else "z", i // 2) for i in range(10)], "id bigint, s string, k bigint")
    rank = F.sha2(F.col("id").cast("string"), 256)
    turn = sampling.quota_sample(df, 7, rank, F.col("s"), "id").orderBy("position").collect()
    assert [r.s for r in turn] == ["a", "b", "c", "z", "a", "b", "c"]
    assert sampling.quota_sample(df, 100, rank, F.col("s"), "id").count() == 10
    assert sorted(r.id for r in sampling.keep_first(df, ["k"], ["id"]).collect()) == [0, 2, 4, 6, 8]
    assert [value(spark, sampling.van_der_corput(F.lit(k))) for k in range(5)] == [0, 0.5, 0.25, 0.75, 0.125]
    assert sorted(r.part for r in sampling.first_n_split(df, 3, rank, "id").collect()).count("sft") == 3
    many = spark.range(4000).select("id", (F.col("id") % 1300).cast("string").alias("s"))
    assert sampling.balanced_sample(many, 2600, "s", F.sha2(F.col("id").cast("string"), 256), "id").groupBy("s").count().filter("count = 2").count() == 1300
    ranks = sorted((r.id for r in many.collect()), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    for n in (0, 1, 777, 4000, 5000):
        assert {r.id for r in sampling.lowest(many, n, F.sha2(F.col("id").cast("string"), 256), "id").collect()} == set(ranks[:n])
        assert {r.id for r in sampling.first_n_split(many, n, F.sha2(F.col("id").cast("string"), 256), "id").filter("part = 'sft'").collect()} == set(ranks[:n])
    assert {r.s: r["count"] for r in sampling.balanced_sample(df, 6, "s", rank, "id").groupBy("s").count().collect()} == {"a": 2, "b": 2, "c": 1, "z": 1}


def test_balancing():
    sizes = [8, 7, 6, 5, 4]
    for parts in (batches.karmarkar_karp(sizes, 2), batches.greedy_parts(sizes, 2)):
        assert sorted(i for p in parts for i in p) == list(range(5))
        assert abs(sum(sizes[i] for i in parts[0]) - sum(sizes[i] for i in parts[1])) <= 4
    assert all(sum(sizes[i] for i in p) <= 12 for p in batches.token_budget_batches(sizes, 12))


def test_balancing_of_all_batches(spark, tmp_path):
    """Every customer has a part in a batch of consecutive keys; a small batch is near the best split by brute force."""
    n, k = 2 * q_data.BATCH_ROWS + 7, 4
    size = {3 * i: (i * i * 7919) % 10_000 for i in range(n)}
    spark.createDataFrame([(c, c % 25, -float(x) - 0.5) for c, x in size.items()], "c_custkey bigint, c_nationkey bigint, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    for name, part in (("srt13_karmarkar_karp", "part"), ("srt14_greedy_parts", "part"), ("srt15_token_budget", "part"), ("srt18_rank_balance", "rank")):
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(r.k for r in rows) == sorted(size), name
        assert all(r.g == r.k // 3 // q_data.BATCH_ROWS for r in rows), name
        loads = Counter()
        for r in rows:
            loads[r.g, r[part]] += size[r.k]
        if name == "srt15_token_budget":
            assert max(loads.values()) <= 20_000
            continue
        last = [size[r.k] for r in rows if r.g == 2]
        best = min(max(sum(x for x, p in zip(last, at) if p == q) for q in range(k)) for at in product(range(k), repeat=len(last)))
        assert len(last) == 7 and best <= max(v for (g, _), v in loads.items() if g == 2) <= 4 / 3 * best
        for g in (0, 1):
            own = [v for (h, _), v in loads.items() if h == g]
            assert len(own) == k and max(own) - min(own) <= max(size.values())


def test_inverse_permutation_of_all_rows(spark, tmp_path):
    """All rows are inverted, and an id that stands twice is found wherever it is."""
    ids = [(7 * i) % 800 for i in range(800)]
    rows = spark.createDataFrame(list(enumerate(ids)), "row_id bigint, ord bigint")
    assert sorted((r.old_place, r.row_id) for r in sampling.inverse_permutation(rows, "ord", "row_id", "old_place").collect()) == sorted((j, i) for i, j in enumerate(ids))
    for bad in (798, -1, 800, None):
        path = str(tmp_path / str(bad))
        rows.withColumn("ord", F.when(F.col("ord") == 799, F.lit(bad)).otherwise(F.col("ord"))).write.parquet(f"{path}/source_rows.parquet")
        with pytest.raises(ValueError, match="no permutation"):
            catalog.QUERIES["srt17_reverse_index"](spark, path).collect()


def test_weighted_draws(spark):
    """Every draw falls into the interval of its row, also where one row owns nearly all weight and others none."""
    rows = spark.createDataFrame([(i, 0 if i % 10 == 0 else 10**9 if i == 77 else i) for i in range(300)], "id bigint, w bigint")
    got = {r.draw: r.id for r in sampling.weighted_draws(rows, "id", F.col("w"), 5000, "s").collect()}
    upto, edges = 0, []
    for r in sorted(rows.collect()):
        upto += r.w
        edges.append((upto, r.id))
    total = upto
    for k in range(5000):
        u = int(hashlib.sha256(f"s:{k}".encode()).hexdigest()[:15], 16) % total
        assert got[k] == next(i for top, i in edges if u < top)
    assert len(got) == 5000 and sampling.weighted_draws(rows.filter("w = 0"), "id", F.col("w"), 9, "s").count() == 0


def test_batches_of_different_facts(spark):
    a, b = spark.range(2).toDF("id"), spark.range(3).toDF("id").withColumn("x", F.lit(1))
    rows, facts = batches.concat([(a, {"m": 1}), (b, {"m": 1, "k": 2})])
    assert rows.count() == 5 and rows.filter("x is null").count() == 2 and facts == {"m": 1, "k": 2}
    with pytest.raises(ValueError, match="disagree"):
        batches.concat([(a, {"m": 1}), (b, {"m": 2})])


def test_bootstrap_draws_from_all_values(spark, tmp_path):
    """The figures are those of resamples drawn from all sorted values of a group, not from its smallest."""
    values = {"a": [float(i) for i in range(500)], "b": [7.0], "c": [-1.5, 2.5, 2.5]}
    rows = [(k, g, v) for k, (g, v) in enumerate((g, v) for g, x in values.items() for v in x)] + [(900, "c", None)]
    spark.createDataFrame(rows, "c_custkey bigint, c_mktsegment string, c_acctbal double").repartition(5).write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.g: r for r in catalog.QUERIES["agg29_bootstrap"](spark, str(tmp_path)).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        at = sampling.hash_number("42", F.lit(g), F.col("b"), F.col("i")) % len(x)
        drawn = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("b")).select("b", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("b", at.alias("at")).collect()
        samples = [[sorted(x)[r.at] for r in drawn[4 * k : 4 * k + 4]] for k in range(1000)]
        for name, f in (("best", max), ("worst", min), ("mean", fmean)):
            y = [f(v) for v in samples]
            assert got[g][f"{name}_mean"] == pytest.approx(fmean(y), abs=1e-4) and got[g][f"{name}_std"] == pytest.approx(pstdev(y), abs=1e-4), (g, name)
    assert 380 < got["a"].best_mean < 420


def test_groups_of_one_and_masked_sequences(spark):
    t = spark.createDataFrame([(1, 1, 1, 0.5, 0.1, -1.0, -0.9, -1.1, 1), (1, 1, 2, 0.5, 0.1, -1.0, -0.9, -1.1, 1), (2, 2, 1, 1.0, 0.0, -1.0, -1.0, -1.0, 0)], "seq bigint, uid bigint, pos int, reward double, value double, old_lp double, lp double, ref_lp double, mask int")
    s = rollouts.sequences(t)
    assert {r.seq: r.advantage for r in rollouts.rloo(s).collect()} == {1: 1.0, 2: 1.0}
    assert {r.seq: r.advantage for r in rollouts.rloo(s, True).collect()} == {1: 0.0, 2: 0.0}
    assert {r.seq: round(r.advantage, 5) for r in rollouts.grpo(s).collect()} == {1: 1.0, 2: 1.0}
    w = {(r.seq, r.pos): r.weight for r in rollouts.trajectory_weights(t, F.lit(0.0)).collect()}
    assert w == {(1, 1): 0.5, (1, 2): 0.5, (2, 1): 0.0}


def test_majority(spark):
    df = spark.createDataFrame([(1, "A", 0.9, 1), (1, "B", 0.8, 2), (1, "A", 0.7, 3)], "g int, v string, x double, o int")
    assert tuple(rollouts.majority_value(df, "g", "v", "x", "o").first()) == (1, "A", 0.9)


def test_monitor():
    state, stops = None, []
    for step in range(1, 101):
        state = monitor.update(state, step, 1.0)
        stops.append(state[3])
    assert state[3] == 40 and stops[38] == -1  # the first window of 20 steps, then two more without a gain


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.dump_json({"b": 1, "a": "é"}, path)
    assert open(path, encoding="utf-8").read() == '{\n  "a": "é",\n  "b": 1\n}\n'
    df = spark.createDataFrame([(1, (2, (3,)))], "a int, b struct<c:int,d:struct<e:int>>")
    assert files.flatten(df).columns == ["a", "b.c", "b.d.e"]
    one = files.ordered_digest(spark.range(3000).select("id", F.col("id").alias("o")), "id", "o").first()
    two = files.ordered_digest(spark.range(3000).select("id", F.col("id").alias("o")).repartition(7), "id", "o").first()
    assert one == two and one["blocks"] == 3


def test_byte_windows_drop_cut_lines(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part.txt").write_bytes(b"".join(f"line {i:03d}\n".encode() for i in range(100)))  # nine bytes each
    spark.dataSource.register(windows.WindowSource)
    read = lambda offsets, length: sorted((r.offset, r.line) for r in spark.read.format("byte_windows").option("path", str(tmp_path / "a")).option("offsets", offsets).option("length", length).load().collect())
    assert read("0,450", 30) == [(0, "line 001"), (0, "line 002"), (450, "line 051"), (450, "line 052")]
    assert read("890", 100) == [(890, "line 099")] and read("5000", 10) == [] and read("0", 3) == []


def test_json_values(spark):
    same = lambda a, b: value(spark, grading.json_equal(F.lit(a), F.lit(b)))
    assert same('{"a":1, "b":[2]}', '{"b": [2], "a": 1}') and same("(1, 2)", "[1,2]") and same("(3,)", "[3]") and same("null", " null ")
    assert not same("[1, 2]", "[2, 1]") and not same("{", "{") and not same("1", "2") and not same(None, "1")


def test_run_codes(spark):
    rows = [(1, 1, 1.0, None, True), (1, 2, 1.0, None, True), (2, 1, 1.0, None, False), (2, 2, 9.0, None, True), (3, 1, 9.0, None, True), (3, 2, 1.0, "x", True), (4, 1, 1.0, "x", True), (5, 1, 8.0, None, True), (5, 2, 8.0, None, True), (6, 1, 1.0, None, None)]
    cases = spark.createDataFrame(rows, "task int, k int, seconds double, error string, right boolean")
    got = {r.task: r.code for r in grading.run_codes(cases, "task", ["k"], 5.0, 15.0).collect()}
    assert got == {1: 1, 2: -2, 3: -3, 4: -4, 5: -1, 6: -2}


def test_extractors(spark):
    df = spark.createDataFrame(
        [(1, 1, "s", "a", "", "What is the sum of two and three here? Put the answer in \\boxed{}.", "open", "Physics"), (2, 2, "s", "a", "", "WHAT is the sum of two and three here!", "open", "Physics"), (3, 3, "s", "b", "", "too short", "open", "Physics"), (4, 4, "s", "c", "", "What is the sum of two and three here? (Answer: X)", "open", "Physics"), (5, 5, "s", "d", "", "Another question with enough letters in it?", "mcq", "Physics"), (6, 6, "s", None, "", None, "open", "Physics")],
        "row_id bigint, ord bigint, source string, source_id string, label string, problem string, question_type string, topic string",
    )
    assert [(r.row_id, r.body) for r in extractors.opd_science(df).collect()] == [(1, "What is the sum of two and three here?")]
    assert extractors.opd_science(df.limit(0)).count() == 0
    with pytest.raises(KeyError, match="no extractors"):
        q_extract.extractors_for("test")


def test_answers_as_numbers_and_intervals(spark):
    same = lambda a, b: value(spark, grading.answer_equal(F.lit(a), F.lit(b)))
    for a, b in (("1/2", "0.5"), ("50%", "0.5"), ("1,000", "1000.00001"), ("(1, 2]", "(1.0,2]"), ("\\frac12", "\\frac{1}{2}"), ("[ -1/2 , x )", "[-0.5,x)")):
        assert same(a, b), (a, b)
    for a, b in (("(1, 2]", "[1, 2]"), ("(1, 2)", "(2, 1)"), ("(1, 2)", "(1, 2, 3)"), ("1", "2"), ("x", "y"), (None, "1"), ("", "1")):
        assert not same(a, b), (a, b)
