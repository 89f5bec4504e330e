"""Quality of responses, gates and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import prompts, text
from loomspark.operators import quality
from loomspark.plans.q_text import RESPONSES, norm, responses, sql_grams, sql_words
from loomspark.plans.registry import query
from loomspark.session import load

_CUT = "(truncated OR coalesce(finish, '') = 'length' OR coalesce(tokens, 0) >= 400)"


@query("flt1_min_length", "SELECT row_id FROM source_rows WHERE length(trim(prompt)) >= 24")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").filter(F.length(F.trim("prompt")) >= 24).select("row_id")


@query("flt7_complete_responses", f"SELECT response_id, NOT {_CUT} AS retained FROM {RESPONSES}")
def flt7(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("response_id", (~quality.is_truncated(F.col("tokens"), F.col("finish"), F.col("truncated"), 400)).alias("retained"))


_V = f"""r AS (SELECT response_id, domain, tokens, coalesce(teacher_response, '') AS t FROM {RESPONSES} WHERE domain IS NOT NULL),
s AS (SELECT *, contains(t, '</think>') AS closed, CASE WHEN contains(t, '</think>') THEN substr(t, instr(t, '</think>') + 8) ELSE t END AS a, CASE WHEN contains(t, '</think>') THEN replace(split_part(t, '</think>', 1), '<think>', '') ELSE '' END AS q FROM r),
u AS (SELECT *, CASE WHEN closed THEN a ELSE t END AS span FROM s),
w AS (SELECT *, CASE WHEN regexp_matches(t, '[^\\s\\p{{Z}}\\x{{85}}]') THEN regexp_split_to_array(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+') ELSE [] END AS tw, CASE WHEN regexp_matches(a, '[^\\s\\p{{Z}}\\x{{85}}]') THEN regexp_split_to_array(regexp_replace(a, '^\\s+|\\s+$', '', 'g'), '\\s+') ELSE [] END AS aw, CASE WHEN regexp_matches(q, '[^\\s\\p{{Z}}\\x{{85}}]') THEN regexp_split_to_array(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), '\\s+') ELSE [] END AS qw FROM u),
g AS (SELECT *, {sql_grams('tw', 8)} AS tg, {sql_grams('aw', 8)} AS ag, {sql_grams('qw', 8)} AS qg FROM w),
v AS (SELECT *, greatest(CASE WHEN len(tg) = 0 THEN 0.0 ELSE (len(tg) - len(list_distinct(tg)))::DOUBLE / len(tg) END, CASE WHEN len(ag) = 0 THEN 0.0 ELSE (len(ag) - len(list_distinct(ag)))::DOUBLE / len(ag) END, CASE WHEN len(qg) = 0 THEN 0.0 ELSE (len(qg) - len(list_distinct(qg)))::DOUBLE / len(qg) END) AS rate FROM g),
j AS (SELECT response_id, domain, tokens, list_filter([CASE WHEN NOT regexp_matches(t, '[^\\s\\p{{Z}}\\x{{85}}]') THEN 'empty' END, CASE WHEN NOT closed THEN 'unclosed_think' END, CASE WHEN closed AND NOT regexp_matches(a, '[^\\s\\p{{Z}}\\x{{85}}]') THEN 'empty_answer_after_think' END, CASE WHEN NOT (CASE WHEN domain IN ('math', 'science') THEN contains(span, '\\boxed{{') WHEN domain = 'code' THEN contains(span, '```') ELSE true END) THEN 'format_missing' END, CASE WHEN rate >= 0.05 THEN 'degenerate_repetition' END], lambda x: x IS NOT NULL) AS reasons FROM v)""".replace("{{", "{").replace("}}", "}")


def judged(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdict(responses(spark, d).filter("domain is not null"), "teacher_response", "domain", F.lit(True), ngram=8, limit=0.05)


@query("flt8_response_verdict", f"WITH {_V} SELECT response_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS usable FROM j")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("response_id", F.array_join("reasons", ",").alias("reasons"), "usable")


@query("flt9_teacher_filter", f"WITH {_V} SELECT domain, count(*) AS n, count(*) FILTER (len(reasons) = 0) AS retained, round(count(*) FILTER (len(reasons) = 0)::DOUBLE / count(*), 9) AS retention FROM j GROUP BY domain")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.count_if("usable").alias("retained"), F.round(F.count_if("usable") / F.count("*"), 9).alias("retention"))


@query("agg4_quality_statistics", f"WITH {_V}, e AS (SELECT domain, unnest(reasons) AS reason FROM j) SELECT NULL AS domain, reason, count(*) AS n, 1 AS over_all FROM e GROUP BY reason UNION ALL SELECT domain, reason, count(*), 0 FROM e GROUP BY domain, reason")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_statistics(judged(spark, d), "domain")


@query("agg5_token_accounting", f"SELECT domain, count(*) AS n, sum(tokens)::BIGINT AS tokens, round(sum(tokens)::DOUBLE / sum(sum(tokens)) OVER (), 9) AS share, round(sum(tokens)::DOUBLE / count(*), 6) AS mean_tokens FROM {RESPONSES} GROUP BY domain")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    return quality.token_accounting(responses(spark, d), "domain", "tokens")


_RP = f"(SELECT r.*, coalesce(p.prompt, '') AS prompt FROM {RESPONSES} r LEFT JOIN (SELECT t.response_id, min(u.prompt) AS prompt FROM teacher_responses t JOIN recovery_pool u USING (sample_id) GROUP BY t.response_id) p USING (response_id))"


def with_prompts(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool").select("sample_id", "prompt")
    p = load(spark, d, "teacher_responses").select("response_id", "sample_id").join(pool, "sample_id").groupBy("response_id").agg(F.min("prompt").alias("prompt"))
    return responses(spark, d).join(p, "response_id", "left").fillna("", ["prompt"])


@query("agg6_format_statistics", f"SELECT domain, count(*) AS n, round(avg(CASE WHEN contains(teacher_response, '</think>') THEN 1 ELSE 0 END), 9) AS think_share, round(avg(CASE WHEN contains(teacher_response, '\\boxed{{') THEN 1 ELSE 0 END), 9) AS boxed_share, round(avg(CASE WHEN contains(teacher_response, '```') THEN 1 ELSE 0 END), 9) AS fenced_share, round(avg(CASE WHEN contains(prompt, '\\boxed{{}}') THEN 1 ELSE 0 END), 9) AS prompt_boxed_share, round(avg(tokens), 6) AS token_mean, CAST(trunc(median(tokens)) AS BIGINT) AS token_median, max(tokens) AS token_max FROM {_RP} GROUP BY domain")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    return quality.format_statistics(with_prompts(spark, d), "domain", "teacher_response", "prompt", "tokens")


@query("flt19_format_warnings", f"SELECT domain, round(avg(CASE WHEN contains(teacher_response, '\\boxed{{') THEN 1 ELSE 0 END), 9) AS boxed_share FROM {_RP} WHERE domain IN ('math', 'science') GROUP BY domain HAVING avg(CASE WHEN contains(teacher_response, '\\boxed{{') THEN 1 ELSE 0 END) < 0.9")
def flt19(spark: SparkSession, d: str) -> DataFrame:
    s = quality.format_statistics(with_prompts(spark, d), "domain", "teacher_response", "prompt", "tokens")
    return s.filter(F.col("domain").isin("math", "science") & (F.col("boxed_share") < 0.9)).select("domain", "boxed_share")


_GW = "list_filter(string_split(" + norm("coalesce(teacher_response, '')") + ", ' '), lambda w: w <> '')"


@query("agg7_generation_diagnostics", f"WITH g AS (SELECT domain AS task, tokens, truncated, coalesce(teacher_response, '') AS t, {sql_grams(_GW, 4)} AS g FROM {RESPONSES}), r AS (SELECT *, CASE WHEN len(g) = 0 THEN 0.0 ELSE (len(g) - len(list_distinct(g)))::DOUBLE / len(g) END AS rate FROM g) SELECT task, count(*) AS outputs, round(avg(truncated::INT), 9) AS truncated_share, round(avg((contains(t, '<think>') AND NOT contains(t, '</think>'))::INT), 9) AS unclosed_share, round(avg((rate >= 0.35)::INT), 9) AS degenerate_share, round(avg(tokens), 6) AS mean_tokens, round(avg(rate), 9) AS mean_repetition FROM r GROUP BY task")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d).withColumn("teacher_response", F.coalesce("teacher_response", F.lit("")))
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    rate = text.repetition_rate(F.filter(F.split(text.normalize(F.col("teacher_response")), " "), lambda w: w != ""), 4)
    t = F.col("teacher_response")
    return rows.withColumn("rate", rate).groupBy(F.col("domain").alias("task")).agg(F.count("*").alias("outputs"), share(F.col("truncated")).alias("truncated_share"), share(F.contains(t, F.lit("<think>")) & ~F.contains(t, F.lit("</think>"))).alias("unclosed_share"), share(F.col("rate") >= 0.35).alias("degenerate_share"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.avg("rate"), 9).alias("mean_repetition"))


_TOK = f"CASE WHEN prompt IS NULL THEN 10001 ELSE len({sql_words(norm('prompt'))}) END"


def _tokens():  # noqa: ANN202
    return F.when(F.col("prompt").isNull(), 10_001).otherwise(F.size(F.filter(F.split(text.normalize(F.col("prompt")), " "), lambda w: w != "")))


@query("flt10_overlong_filter", f"SELECT row_id FROM source_rows WHERE {_TOK} <= 60")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of at most 60 words; a prompt that cannot be read counts as too long."""
    return load(spark, d, "source_rows").filter(_tokens() <= 60).select("row_id")


@query("flt11_overlong_accounting", f"SELECT domain, count(*) AS n, count(*) FILTER ({_TOK} > 60) AS dropped, max({_TOK})::INTEGER AS longest FROM source_rows GROUP BY domain")
def flt11(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").withColumn("t", _tokens()).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("t") > 60).alias("dropped"), F.max("t").alias("longest"))


@query("agg40_dropped_by_domain", f"SELECT domain, count(*) FILTER ({_TOK} > 60) AS dropped FROM source_rows GROUP BY domain")
def agg40(spark: SparkSession, d: str) -> DataFrame:
    return flt11(spark, d).select("domain", "dropped")


@query("flt13_expected_format", f"SELECT response_id, CASE WHEN domain IN ('math', 'science') THEN contains(teacher_response, '\\boxed{{') WHEN domain = 'code' THEN contains(teacher_response, '```') ELSE true END AS expected FROM {RESPONSES} WHERE domain IS NOT NULL AND teacher_response IS NOT NULL")
def flt13(spark: SparkSession, d: str) -> DataFrame:
    rows = responses(spark, d).filter("domain is not null and teacher_response is not null")
    return rows.select("response_id", prompts.has_expected_format(F.col("teacher_response"), F.col("domain")).alias("expected"))


@query("flt14_duplicate_ids", "SELECT sample_id, count(*) AS n FROM recovery_pool GROUP BY sample_id HAVING count(*) > 1")
def flt14(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").groupBy("sample_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("flt18_split_validation", "SELECT split, count(*) AS n, count(DISTINCT sample_id) AS ids FROM recovery_pool GROUP BY split")
def flt18(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids"))


@query("flt20_mode_agreement", "SELECT enable_thinking, round(avg(CASE WHEN contains(teacher_response, '<think>') AND contains(teacher_response, '</think>') THEN 1 ELSE 0 END), 9) AS paired_share, round(avg(CASE WHEN contains(teacher_response, 'think>') THEN 1 ELSE 0 END), 9) AS any_share FROM teacher_responses GROUP BY enable_thinking")
def flt20(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("teacher_response", F.lit(""))
    has = lambda s: F.contains(t, F.lit(s))
    return load(spark, d, "teacher_responses").groupBy("enable_thinking").agg(F.round(F.avg((has("<think>") & has("</think>")).cast("int")), 9).alias("paired_share"), F.round(F.avg(has("think>").cast("int")), 9).alias("any_share"))


@query("agg1_count_by", "SELECT source, count(*) AS n FROM source_rows GROUP BY source")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").groupBy("source").agg(F.count("*").alias("n"))


@query("agg2_domain_counts", "SELECT split, domain, count(*) AS n FROM recovery_pool GROUP BY ALL")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").groupBy("split", "domain").agg(F.count("*").alias("n"))


@query("agg18_manifest_aggregates", f"SELECT count(*) AS n, count(DISTINCT domain) AS domains, sum(tokens)::BIGINT AS tokens, max(tokens) AS longest, round(avg({_CUT}::INT), 9) AS cut_share FROM {RESPONSES}")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    cut = quality.is_truncated(F.col("tokens"), F.col("finish"), F.col("truncated"), 400)
    return responses(spark, d).agg(F.count("*").alias("n"), F.countDistinct("domain").alias("domains"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.round(F.avg(cut.cast("int")), 9).alias("cut_share"))


@query("rcp3_sft_targets", f"WITH {_V}, k AS (SELECT j.* FROM j JOIN {RESPONSES} r USING (response_id) WHERE NOT {_CUT.replace('tokens', 'r.tokens')} AND len(reasons) = 0) SELECT domain, count(*) AS n, sum(tokens)::BIGINT AS tokens, round(sum(tokens)::DOUBLE / sum(sum(tokens)) OVER (), 9) AS share, round(sum(tokens)::DOUBLE / count(*), 6) AS mean_tokens FROM k GROUP BY domain")
def rcp3(spark: SparkSession, d: str) -> DataFrame:
    whole = judged(spark, d).filter(~quality.is_truncated(F.col("tokens"), F.col("finish"), F.col("truncated"), 400))
    return quality.token_accounting(whole.filter("usable"), "domain", "tokens")
