"""Graders and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import grading as gr
from loomspark.functions import text
from loomspark.plans.q_checkers import _P
from loomspark.plans.q_prompts import literal
from loomspark.plans.q_rollouts import _r, rounded
from loomspark.plans.q_text import RESPONSES, responses
from loomspark.plans.registry import query
from loomspark.session import load


def items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark_items").filter("answer is not null")


@query("rew2_hash_answer", "SELECT item_id, answer AS strict, list_last(list_filter(regexp_extract_all(concat(text, ' #### $', answer), '(\\-?[0-9\\.\\,]+)'), lambda x: x NOT IN ('', '.', ','))) AS flexible FROM benchmark_items WHERE regexp_full_match(answer, '\\d+')")
def rew2(spark: SparkSession, d: str) -> DataFrame:
    a = items(spark, d).filter(F.col("answer").rlike(r"^\d+$"))
    return a.select("item_id", gr.hash_answer(F.concat("text", F.lit(" #### "), "answer")).alias("strict"), gr.last_number(F.concat("text", F.lit(" #### $"), "answer")).alias("flexible"))


def sql_math(x: str) -> str:
    """SQL of grading.canonical_math."""
    for old, new in gr.MATH_LITERALS[:10]:
        x = f"replace({x}, {literal(old)}, {literal(new)})"
    x = f"CASE WHEN len(string_split({x}, {literal(gr.UNIT)})) = 2 THEN string_split({x}, {literal(gr.UNIT)})[1] ELSE {x} END"
    for old, new in gr.MATH_LITERALS[10:]:
        x = f"replace({x}, {literal(old)}, {literal(new)})"
    for pattern, new in gr.MATH_RULES:
        x = f"regexp_replace({x}, {literal(pattern)}, {literal(new)}, 'g')"
    return x


#: Ways to write an answer A, and what it is compared with.
WRITTEN = [("x = {A}\\%", "{A}"), ("\\dfrac{{A}}{7}", "{A}/7"), ("\\tfrac{{A}}{7}", "\\frac{{A}}{8}"), ("\\sqrt3 + {A}", "\\sqrt{3}+{A}"), ("{A} \\text{ units}", "{A}"), (".5", "\\frac12"), ("{A}^\\circ", "{A}"), ("\\left({A}, 2\\right)", "({A},3)"), ("ab = {A}", "abc={A}")]


def _written(k: int) -> tuple:
    out = F.lit(None).cast("string")
    for i, pair in enumerate(WRITTEN):
        out = F.when(F.col("item_id") % len(WRITTEN) == i, F.replace(F.lit(pair[k]), F.lit("{A}"), F.col("answer"))).otherwise(out)
    return out


def _written_sql(k: int) -> str:
    return f"CASE item_id % {len(WRITTEN)} " + " ".join(f"WHEN {i} THEN replace({literal(pair[k])}, '{{A}}', answer)" for i, pair in enumerate(WRITTEN)) + " END"


@query("rew3_math_equal", f"WITH a AS (SELECT item_id, {_written_sql(0)} AS x, {_written_sql(1)} AS y FROM benchmark_items WHERE answer IS NOT NULL), c AS (SELECT item_id, {sql_math('x')} AS x, {sql_math('y')} AS y FROM a) SELECT item_id, x AS form, x = y AS same FROM c")
def rew3(spark: SparkSession, d: str) -> DataFrame:
    """Answers written in several ways, in canonical form, against truths written in other ways."""
    a = items(spark, d).select("item_id", _written(0).alias("x"), _written(1).alias("y"))
    return a.select("item_id", gr.canonical_math(F.col("x")).alias("form"), gr.math_equal(F.col("x"), F.col("y")).alias("same"))


@query("rew4_final_answer", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS reward FROM benchmark_items WHERE answer IS NOT NULL AND regexp_full_match(answer, '\\d+')")
def rew4(spark: SparkSession, d: str) -> DataFrame:
    a = items(spark, d).filter(F.col("answer").rlike(r"^\d+$"))
    said = F.concat("text", F.lit("\nAnswer: $x = "), F.col("answer"), F.when(F.col("item_id") % 2 == 0, "$").otherwise("1$"))
    return a.select("item_id", gr.minerva_reward(said, F.col("answer")).alias("reward"))


def _qa(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower({x}), '{_P}', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"



@query("rew5_qa_exact_match", f"SELECT item_id, {_qa('text')} = {_qa(chr(39) + 'The ' + chr(39) + ' || upper(text)')} AS em FROM benchmark_items")
def rew5(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("<think>x</think><answer> "), "text", F.lit(" </answer>"))
    return load(spark, d, "benchmark_items").select("item_id", gr.exact_match(gr.tagged_answer(said), F.array(F.concat(F.lit("The "), F.upper("text")))).alias("em"))


@query("rew6_qa_contains", f"SELECT item_id, contains({_qa('text')}, {_qa('substr(text, 1, 20)')}) AS em FROM benchmark_items")
def rew6(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark_items").select("item_id", gr.contains_match(F.col("text"), F.array(F.substring("text", 1, 20))).alias("em"))


@query("rew7_format_reward", "SELECT item_id, round(CASE WHEN item_id % 3 = 0 THEN 0 ELSE 0.9 END + CASE WHEN item_id % 2 = 0 THEN 0.1 ELSE 0 END, 9)::DOUBLE AS reward FROM benchmark_items WHERE answer IS NOT NULL")
def rew7(spark: SparkSession, d: str) -> DataFrame:
    """Form and answer: every third answer is wrong, every second response lacks the think block."""
    given = F.when(F.col("item_id") % 3 == 0, F.concat("answer", F.lit("9"))).otherwise(F.col("answer"))
    lead = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"))).otherwise(F.col("text"))
    said = F.concat(lead, F.lit("\n\\boxed{"), given, F.lit("}"))
    return items(spark, d).select("item_id", F.round(gr.geometry_reward(said, F.col("answer")), 9).alias("reward"))


@query("rew11_output_comparison", "SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def rew11(spark: SparkSession, d: str) -> DataFrame:
    """Stored outputs against expected ones: line by line, numbers as decimals."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    out = F.concat(size, F.lit(".50 "), key, F.lit("\nend"))
    expected = F.concat(size, F.lit(".5 "), key, F.when(F.col("p_partkey") % 2 == 0, "\nend\n").otherwise("\nEnd"))
    return load(spark, d, "part").select("p_partkey", gr.output_equal(out, expected).alias("same"))


@query("rew12_json_equality", "SELECT event_id, event_id % 5 IN (0, 1, 3) AS same FROM events")
def rew12(spark: SparkSession, d: str) -> DataFrame:
    """Call results as values: spaced otherwise, members turned round, another value, a tuple for a list, and no JSON at all."""
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    want = F.when(k == 3, F.concat(F.lit("["), u, F.lit(", [1, 2]]"))).otherwise(F.concat(F.lit('{"a": '), u, F.lit(', "b": [1, 2]}')))
    got = F.when(k == 0, F.regexp_replace(want, " ", "")).when(k == 1, F.concat(F.lit('{"b":[1,2],"a":'), u, F.lit("}"))).when(k == 2, F.concat(F.lit('{"a": '), u, F.lit(', "b": [1, 3]}')))
    got = got.when(k == 3, F.concat(F.lit("("), u, F.lit(", [1, 2],)"))).otherwise(F.concat(F.lit('{"a": '), u))
    return load(spark, d, "events").select("event_id", gr.json_equal(got, want).alias("same"))


_CASES = "SELECT user_id, event_id, value AS seconds, CASE WHEN event_id % 17 = 0 THEN 'error' END AS error, event_id % 13 <> 0 AS ok FROM events"


@query("rew13_result_codes", f"SELECT user_id, CASE WHEN sum(seconds) > 7000 THEN -1 ELSE coalesce(arg_min(fault, event_id) FILTER (fault IS NOT NULL), 1) END::INTEGER AS code, count(*) AS cases FROM (SELECT *, CASE WHEN error IS NOT NULL THEN -4 WHEN seconds > 480 THEN -3 WHEN NOT ok THEN -2 END AS fault FROM ({_CASES})) GROUP BY user_id")
def rew13(spark: SparkSession, d: str) -> DataFrame:
    """Codes of tasks from their stored cases; a user stands for a task, an event for a case."""
    e = load(spark, d, "events").select("user_id", "event_id", F.col("value").alias("seconds"), F.when(F.col("event_id") % 17 == 0, "error").alias("error"), (F.col("event_id") % 13 != 0).alias("right"))
    return gr.run_codes(e, "user_id", ["event_id"], 480.0, 7000.0)


@query("rew14_flatten_regroup", "SELECT l_orderkey AS task, count(*)::INTEGER AS n, count(*) FILTER (l_quantity > 25)::INTEGER AS correct FROM lineitem GROUP BY l_orderkey")
def rew14(spark: SparkSession, d: str) -> DataFrame:
    """Generations as an array per task, flattened for grading, and put together again."""
    nested = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.collect_list("l_quantity").alias("g"))
    graded = nested.select("task", F.posexplode("g").alias("sample", "q")).groupBy("task").agg(F.collect_list(F.col("q") > 25).alias("ok"))
    return graded.select("task", F.size("ok").alias("n"), F.size(F.filter("ok", lambda x: x)).alias("correct"))


@query("rew15_last_token_reward", "WITH t AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS score FROM lineitem) SELECT seq, pos, CASE WHEN pos = n THEN score ELSE 0 END AS reward FROM t")
def rew15(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey")
    t = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), F.count("*").over(w).alias("n"), F.sum("l_quantity").over(w).alias("score"))
    return t.select("seq", "pos", F.when(F.col("pos") == F.col("n"), F.col("score")).otherwise(0.0).alias("reward"))


@query("rew16_overlong_penalty", f"SELECT response_id, {_r('least(-(tokens - (400 - 100)) / 100.0, 0)', 'penalty')} FROM {RESPONSES} WHERE tokens IS NOT NULL")
def rew16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(responses(spark, d).filter("tokens is not null").select("response_id", gr.overlong_penalty(F.col("tokens"), 400, 100).alias("penalty")))


@query("rew18_zero_reward", "SELECT DISTINCT sample_id, 0.0::DOUBLE AS reward FROM recovery_pool WHERE split = 'opd'")
def rew18(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").filter("split = 'opd'").select("sample_id", F.lit(0.0).alias("reward")).distinct()


#: A data source of each grader, and a response in its form: {T} stands for the item's text, {A} for an answer.
SAID = [
    ("openai/gsm8k", "{T} #### {A}"), ("HuggingFaceH4/MATH-500", "{T} So $x = \\boxed{{A}\\%}$."), ("aime2024", "{T}\nAnswer: $x = {A}$"), ("numina_olympiads", "{T} \\boxed{{A}.0}"),
    ("hiyouga/geometry3k", "<think>{T}</think> \\boxed{ {A} }"), ("searchR1_nq", "<answer> The {A}! </answer>"),
]
_ANSWERED = "CASE WHEN item_id % 5 < 3 THEN answer ELSE answer || '1' END"


def _by_source(values: list, column: bool):
    if column:
        out = F.lit(None).cast("string")
        for i, x in enumerate(values):
            out = F.when(F.col("item_id") % len(values) == i, x).otherwise(out)
        return out
    return f"CASE item_id % {len(values)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


_SAID_SQL = f"SELECT item_id, answer, {_by_source([literal(a) for a, _ in SAID], False)} AS source, {_by_source([f'replace(replace({literal(b)}, {chr(39)}{{A}}{chr(39)}, {_ANSWERED}), {chr(39)}{{T}}{chr(39)}, text)' for _, b in SAID], False)} AS said, {_ANSWERED} AS given FROM benchmark_items WHERE answer IS NOT NULL"


@query("rew1_dispatch", f"WITH s AS ({_SAID_SQL}) SELECT item_id, source, round(CASE WHEN source = 'aime2024' THEN CASE WHEN given = answer THEN 1 ELSE -1 END WHEN source = 'hiyouga/geometry3k' THEN 0.1 + CASE WHEN given = answer THEN 0.9 ELSE 0 END ELSE (given = answer)::INT END::DOUBLE, 9) AS score FROM s")
def rew1(spark: SparkSession, d: str) -> DataFrame:
    """Graders by data source, over responses in the form that each reads, two fifths of them with a wrong answer."""
    given = F.when(F.col("item_id") % 5 < 3, F.col("answer")).otherwise(F.concat("answer", F.lit("1")))
    said = _by_source([F.replace(F.replace(F.lit(b), F.lit("{A}"), given), F.lit("{T}"), F.col("text")) for _, b in SAID], True)
    a = items(spark, d).select("item_id", _by_source([F.lit(x) for x, _ in SAID], True).alias("source"), said.alias("said"), "answer")
    return a.select("item_id", "source", F.round(gr.graded(F.col("source"), F.col("said"), F.col("answer")), 9).alias("score"))


_PK = "1 - list_aggregate(list_concat([1.0::DOUBLE], list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k} / i)), 'product')"
_TASKS = "(SELECT l_orderkey AS task, count(*) AS n, count(*) FILTER (l_quantity > 25) AS c FROM lineitem GROUP BY l_orderkey)"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("c"))


@query("agg12_pass_at_k", f"SELECT task, {_r('CASE WHEN n - c < 1 THEN 1 ELSE ' + _PK.format(k=1) + ' END', 'pass_1')}, {_r('CASE WHEN n - c < 3 THEN 1 ELSE ' + _PK.format(k=3) + ' END', 'pass_3')} FROM {_TASKS} WHERE n >= 3")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tasks(spark, d).filter("n >= 3").select("task", gr.pass_at_k(F.col("n"), F.col("c"), 1).alias("pass_1"), gr.pass_at_k(F.col("n"), F.col("c"), 3).alias("pass_3")))


@query("agg13_pass_at_k_metrics", f"SELECT {_r('avg(CASE WHEN n - c < 2 THEN 1 ELSE ' + _PK.format(k=2) + ' END)', 'pass_2')}, min(n)::BIGINT AS least_samples FROM {_TASKS} WHERE n >= 2")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tasks(spark, d).filter("n >= 2").agg(F.avg(gr.pass_at_k(F.col("n"), F.col("c"), 2)).alias("pass_2"), F.min("n").alias("least_samples")))


@query("agg14_instance_grades", "SELECT o_custkey AS task, array_to_string(list((o_totalprice > 200000)::INT ORDER BY o_orderkey), ',') AS grades FROM orders GROUP BY o_custkey")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    g = F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") > 200000).cast("int").alias("g"))))
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.array_join(F.transform(g, lambda x: x["g"]), ",").alias("grades"))


@query("agg8_average_at_n", "WITH s AS (SELECT o_orderpriority AS benchmark, o_custkey, o_totalprice > 200000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT benchmark, round(avg(ok::INT), 9) AS avg_at_n, round(avg(ok::INT) FILTER (k = 1), 9) AS first_pass FROM s GROUP BY benchmark")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    s = load(spark, d, "orders").select(F.col("o_orderpriority").alias("benchmark"), (F.col("o_totalprice") > 200000).cast("int").alias("ok"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    return s.groupBy("benchmark").agg(F.round(F.avg("ok"), 9).alias("avg_at_n"), F.round(F.avg(F.when(F.col("k") == 1, F.col("ok"))), 9).alias("first_pass"))


@query("agg9_accuracy", "SELECT o_orderpriority AS benchmark, round(avg((o_totalprice > 200000)::INT), 9) AS accuracy, count(*) AS n FROM orders GROUP BY benchmark")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("benchmark")).agg(F.round(F.avg((F.col("o_totalprice") > 200000).cast("int")), 9).alias("accuracy"), F.count("*").alias("n"))


SAMPLES = 4
_GENERATED = f"SELECT item_id, benchmark, k, answer, CASE WHEN (item_id * 7 + k * 3) % 11 = 0 THEN text ELSE text || CASE WHEN benchmark = 'science_hard' THEN ' The result is \\boxed{{' ELSE ' Hence \\boxed{{0' END || CASE WHEN (item_id * 5 + k * 3) % 7 < 4 THEN answer ELSE answer || '7' END || '}}' END AS said FROM benchmark_items, range({SAMPLES}) r(k) WHERE answer IS NOT NULL"


@query(
    "rcp12_evaluate_generations",
    f"""WITH g AS ({_GENERATED}), x AS (SELECT *, regexp_extract(said, 'boxed[{{]([^}}]*)[}}]$', 1) AS b FROM g),
s AS (SELECT *, b <> '' AND CASE WHEN benchmark = 'science_hard' THEN b = answer ELSE try_cast(b AS BIGINT) = try_cast(answer AS BIGINT) END AS ok FROM x),
t AS (SELECT benchmark, item_id, count(*) AS n, count(*) FILTER (ok) AS c, bool_or(ok AND k = 0) AS first, count(*) FILTER (b <> '') AS boxed FROM s GROUP BY ALL)
SELECT benchmark, count(*) AS items, round(sum(c) / sum(n), 7) AS avg_at_n, round(avg(first::INT), 7) AS first_pass, {_r('avg(CASE WHEN n - c < 2 THEN 1 ELSE ' + _PK.format(k=2) + ' END)', 'pass_2')}, round(sum(boxed) / sum(n), 7) AS boxed_share FROM t GROUP BY benchmark""",
)
def rcp12(spark: SparkSession, d: str) -> DataFrame:
    """Stored generations graded against the items' answers: mean over samples, first sample, pass@2, share with a box.

    Every item with an answer has four generations, some without a box, some with another answer, numbers with a zero before.
    """
    item, k = F.col("item_id"), F.col("k")
    given = F.when((item * 5 + k * 3) % 7 < 4, F.col("answer")).otherwise(F.concat("answer", F.lit("7")))
    lead = F.when(F.col("benchmark") == "science_hard", " The result is \\boxed{").otherwise(" Hence \\boxed{0")
    said = F.when((item * 7 + k * 3) % 11 == 0, F.col("text")).otherwise(F.concat("text", lead, given, F.lit("}")))
    g = items(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("said", said)
    inside = text.boxed(F.col("said"))
    right = F.when(F.col("benchmark") == "science_hard", gr.math_equal(inside, F.col("answer"))).otherwise(text.normalize_number(inside) == text.normalize_number(F.col("answer")))
    s = g.select("benchmark", "item_id", "k", F.coalesce(right, F.lit(False)).alias("ok"), F.coalesce(inside != "", F.lit(False)).alias("boxed"))
    t = s.groupBy("benchmark", "item_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"), F.bool_or(F.col("ok") & (F.col("k") == 0)).cast("int").alias("first"), F.count_if("boxed").alias("boxed"))
    share = lambda x: F.round(F.sum(x) / F.sum("n"), 9)
    return rounded(t.groupBy("benchmark").agg(F.count("*").alias("items"), share("c").alias("avg_at_n"), F.round(F.avg("first"), 9).alias("first_pass"), F.avg(gr.pass_at_k(F.col("n"), F.col("c"), 2)).alias("pass_2"), share("boxed").alias("boxed_share")))
