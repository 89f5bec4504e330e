"""Extractors: source records of several shapes become rows (row_id, ord, source, source_id, body, label).

Each shape has its own way to the question (a column, the first user turn, a nested JSON path, a placeholder that points
into a public table) and its own conditions; what they share are the two ways to make a row of a question, as a text whose
format instructions are taken away, or as a code task without its harness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import prompts, text
from loomspark.operators import sampling

MIN_CHARS = 24
SCIENCE_TOPICS = ("Physics", "Chemistry", "Biology")
FIELDS = ("row_id", "ord", "source", "source_id", "label")


def text_rows(df: DataFrame, question: Column, domain: str) -> DataFrame:
    """Rows of a suffix domain: long enough before and after stripping, and without a second request for a format."""
    rows = df.withColumn("_q", text.strip(question)).filter(F.length("_q") >= MIN_CHARS)
    rows = text.once(rows, "body", prompts.strip_column(F.col("_q"))).filter(F.length("body") >= MIN_CHARS)
    bare = prompts.without_suffix(F.col("_q"))
    aligned = F.when(bare == F.col("_q"), F.concat("body", F.lit(prompts.SUFFIXES[domain]))).otherwise(prompts.align_column(F.col("_q"), F.lit(domain)))
    return rows.filter(prompts.competing_count(aligned, F.lit(domain)) == 0).select(*FIELDS, "body")


def code_rows(df: DataFrame, question: Column) -> DataFrame:
    """Rows of the code domain: the question without its harness and its format instructions."""
    return text.once(df, "body", prompts.strip_column(prompts.strip_harness(question))).filter(F.length("body") >= MIN_CHARS).select(*FIELDS, "body")


def by_text(rows: DataFrame) -> DataFrame:
    """The first row of each normalized text."""
    return sampling.keep_first(rows.withColumn("_key", text.normalize(F.col("body"))), ["_key"], ["ord", "row_id"]).select(*FIELDS, "body")


def by_id(rows: DataFrame) -> DataFrame:
    """The first row of each id of a source."""
    return sampling.keep_first(rows, ["source", "source_id"], ["ord", "row_id"]).select(*FIELDS, "body")


def id_or(first: Column, second: Column) -> Column:
    """The id, or the other where it is missing or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second.cast("string"))


def without_tools(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.size("tools"), F.lit(0)) <= 0)


def sft_math(df: DataFrame) -> DataFrame:
    return by_text(text_rows(df, F.col("problem"), "math"))


def sft_code(df: DataFrame) -> DataFrame:
    return by_id(code_rows(without_tools(df), F.coalesce(text.first_content(F.col("messages"), "user"), F.lit(""))))


def sft_science(df: DataFrame) -> DataFrame:
    rows = without_tools(df).filter(F.col("topic").isin(*SCIENCE_TOPICS) & (F.col("question_format") == "OpenQ"))
    return by_text(text_rows(rows, F.coalesce(text.first_content(F.col("messages"), "user"), F.lit("")), "science"))


def sft_instructions(df: DataFrame) -> DataFrame:
    """Prompts as they stand, with the system turn in `label`, as it may carry part of the task."""
    rows = df.withColumn("body", F.coalesce(text.first_content(F.col("messages"), "user"), F.lit(""))).filter(F.length(text.strip(F.col("body"))) >= MIN_CHARS)
    system = F.coalesce(text.first_content(F.col("messages"), "system"), F.lit(""))
    return by_text(rows.withColumn("label", F.when(text.strip(system) != "", system).otherwise("")).select(*FIELDS, "body"))


def restore(df: DataFrame, public: DataFrame) -> DataFrame:
    """`problem` and `label` of rows whose `place` (data set, row, prefix, suffix) points into `public` (data set, row, question)."""
    known = public.select(F.col("dataset").alias("_d"), F.col("row").alias("_r"), F.col("question").alias("_public"))
    joined = df.join(known, (F.col("place.dataset") == F.col("_d")) & (F.col("place.row") == F.col("_r")), "left")
    written = F.concat(F.coalesce("place.prefix", F.lit("")), "_public", F.coalesce("place.suffix", F.lit("")))
    joined = joined.withColumn("problem", F.when(F.col("place").isNull(), F.col("problem")).otherwise(written))
    return joined.withColumn("label", F.when(F.col("place").isNull(), "native").otherwise(F.col("place.dataset"))).drop("_d", "_r", "_public")


def opd_math(df: DataFrame, public: DataFrame, supplement: DataFrame) -> DataFrame:
    """Restored questions, then those of the supplement that they do not have."""
    own = by_text(text_rows(restore(df, public), F.col("problem"), "math"))
    both = own.withColumn("_p", F.lit(0)).unionByName(sft_math(supplement).withColumn("label", F.lit("supplement")).withColumn("_p", F.lit(1)))
    return sampling.keep_first(both.withColumn("_key", text.normalize(F.col("body"))), ["_key"], ["_p", "ord", "row_id"]).select(*FIELDS, "body")


def opd_code(df: DataFrame) -> DataFrame:
    """Questions at `input[0].content` of JSON text; what cannot be parsed or holds none is left out."""
    params = F.from_json("params", "input array<struct<role string, content string>>")
    content = F.get(params["input"], 0)["content"]
    return by_id(code_rows(df.withColumn("_c", content).filter(F.coalesce("_c", F.lit("")) != ""), F.col("_c")))


def opd_science(df: DataFrame) -> DataFrame:
    return by_text(text_rows(df.filter((F.col("question_type") == "open") & F.col("topic").isin(*SCIENCE_TOPICS)), F.col("problem"), "science"))


def opd_instructions(df: DataFrame) -> DataFrame:
    """Prompts of one to five constraints; `label` gives their number, the first family in order, and the number of families."""
    rows = df.withColumn("body", F.coalesce(text.first_content(F.col("messages"), "user"), F.lit(""))).filter(F.length(text.strip(F.col("body"))) >= MIN_CHARS)
    rows = rows.withColumn("_n", text.constraint_count(F.coalesce("constraint", F.lit("")))).filter("_n between 1 and 5")
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("ground_truth", F.lit("")), F.lit(r"'([a-z_]+:[a-z_\-]+)'"), F.lit(1)))
    label = F.concat_ws("|", F.col("_n").cast("string"), F.coalesce(F.array_min(ids), F.lit("")), F.size(ids).cast("string"))
    return by_id(rows.withColumn("label", label).select(*FIELDS, "body"))
