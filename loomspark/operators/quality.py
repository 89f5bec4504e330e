"""Quality of stored responses: completeness, verdicts with reasons, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import prompts, text

REPETITION_NGRAM, REPETITION_LIMIT = 32, 0.35


def is_truncated(tokens: Column, finish: Column, flag: Column, max_tokens: int) -> Column:
    """Cut by the producer: flagged, finished by length, or as long as allowed. Missing values say nothing."""
    return F.coalesce(flag, F.lit(False)) | (F.coalesce(finish, F.lit("")) == "length") | (F.coalesce(tokens, F.lit(0)) >= max_tokens)


def verdict(df: DataFrame, response: str, domain: str, thinking: Column, ngram: int = REPETITION_NGRAM, limit: float = REPETITION_LIMIT) -> DataFrame:
    """df with reasons (array), usable, and the repetition rates of the response, its reasoning and its answer."""
    r = F.coalesce(F.col(response), F.lit(""))
    df = df.withColumn("_reasoning", text.reasoning(r)).withColumn("_answer", text.answer(r))
    rate = lambda c: text.repetition_rate(text.split_words(c), ngram)
    df = df.withColumn("repetition_rate", rate(r)).withColumn("repetition_rate_reasoning", rate(F.col("_reasoning"))).withColumn("repetition_rate_answer", rate(F.col("_answer")))
    closed = F.contains(r, F.lit(text.THINK_CLOSE))
    blank = lambda c: ~c.rlike(r"(?U)\S")
    span = F.when(thinking & closed, F.col("_answer")).otherwise(r)
    reasons = F.array_compact(
        F.array(
            F.when(blank(r), F.lit("empty")),
            F.when(thinking & ~closed, F.lit("unclosed_think")),
            F.when(thinking & closed & blank(F.col("_answer")), F.lit("empty_answer_after_think")),
            F.when(~prompts.has_expected_format(span, F.col(domain)), F.lit("format_missing")),
            F.when(F.greatest("repetition_rate", "repetition_rate_reasoning", "repetition_rate_answer") >= limit, F.lit("degenerate_repetition")),
        )
    )
    return df.withColumn("reasons", reasons).withColumn("usable", F.size("reasons") == 0).drop("_reasoning", "_answer")


def quality_statistics(judged: DataFrame, domain: str) -> DataFrame:
    """(domain or null, reason, n): rejected rows by reason, and by domain and reason."""
    rows = text.explode_once(judged.withColumnRenamed(domain, "domain"), F.col("reasons"), "reason", "domain")
    return rows.groupingSets([["reason"], ["domain", "reason"]], "domain", "reason").agg(F.count("*").alias("n"), F.grouping("domain").cast("int").alias("over_all"))


def token_accounting(df: DataFrame, domain: str, tokens: str) -> DataFrame:
    """Rows, tokens, share of all tokens and mean per domain."""
    per = df.groupBy(domain).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"))
    total = df.agg(F.sum(tokens).alias("_total"))
    return per.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("tokens") / F.col("_total"), 9)).withColumn("mean_tokens", F.round(F.col("tokens") / F.col("n"), 6)).drop("_total")


def format_statistics(df: DataFrame, domain: str, response: str, prompt: str, tokens: str) -> DataFrame:
    """Shares of responses with think end, box and fence, of prompts with a box marker; token mean, median, maximum."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 9)
    has = lambda c, s: F.contains(F.col(c), F.lit(s))
    return df.groupBy(domain).agg(
        F.count("*").alias("n"),
        share(has(response, text.THINK_CLOSE)).alias("think_share"),
        share(has(response, "\\boxed{")).alias("boxed_share"),
        share(has(response, "```")).alias("fenced_share"),
        share(has(prompt, "\\boxed{}")).alias("prompt_boxed_share"),
        F.round(F.avg(tokens), 6).alias("token_mean"),
        F.median(tokens).cast("bigint").alias("token_median"),
        F.max(tokens).alias("token_max"),
    )


def generation_diagnostics(df: DataFrame, task: str, response: str, tokens: str, truncated: str, ngram: int = 4, limit: float = REPETITION_LIMIT) -> DataFrame:
    """Per task: outputs, shares that are cut, not closed or degenerate, mean tokens and repetition."""
    r = F.coalesce(F.col(response), F.lit(""))
    rows = df.withColumn("_rate", text.repetition_rate(text.split_words(r), ngram))
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    return rows.groupBy(task).agg(
        F.count("*").alias("outputs"),
        share(F.col(truncated)).alias("truncated_share"),
        share(F.contains(r, F.lit(text.THINK_OPEN)) & ~F.contains(r, F.lit(text.THINK_CLOSE))).alias("unclosed_share"),
        share(F.col("_rate") >= limit).alias("degenerate_share"),
        F.round(F.avg(tokens), 6).alias("mean_tokens"),
        F.round(F.avg("_rate"), 9).alias("mean_repetition"),
    )


def mask_provenance(masks: DataFrame, expected: Column, default: str = "minitron") -> DataFrame:
    """(arm, expected, problems, passed): masks of each arm (arm, pruning_method) that another method made."""
    m = masks.withColumn("expected", expected)
    g = m.groupBy("arm", "expected").agg(F.count_if(F.coalesce("pruning_method", F.lit(default)) != F.col("expected")).alias("problems"))
    return g.withColumn("passed", F.col("problems") == 0)
