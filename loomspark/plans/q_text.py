"""Queries over the text and prompt functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import prompts, text
from loomspark.operators import contamination
from loomspark.plans.registry import query
from loomspark.session import load, spread


def norm(x: str) -> str:
    """SQL of text.normalize."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def sql_words(x: str) -> str:
    """SQL of the words of normalized text."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_grams(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' ')) ELSE [] END"


#: One row per response, as ids are delivered again at times.
RESPONSES = "(SELECT response_id, min(domain) AS domain, min(teacher_response) AS teacher_response, max(teacher_response_tokens) AS tokens, min(teacher_finish_reason) AS finish, bool_or(coalesce(teacher_truncated, false)) AS truncated FROM teacher_responses GROUP BY response_id)"


def responses(spark: SparkSession, d: str) -> DataFrame:
    t = spread(load(spark, d, "teacher_responses").select("response_id", "domain", "teacher_response", "teacher_response_tokens", "teacher_finish_reason", "teacher_truncated"))
    return t.groupBy("response_id").agg(F.min("domain").alias("domain"), F.min("teacher_response").alias("teacher_response"), F.max("teacher_response_tokens").alias("tokens"), F.min("teacher_finish_reason").alias("finish"), F.bool_or(F.coalesce("teacher_truncated", F.lit(False))).alias("truncated"))


@query("sca1_normalize", f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def sca1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@query("sca2_dedup_key", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS dedup_key FROM documents")
def sca2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("dedup_key"))


@query("sca3_prompt_hash", f"SELECT row_id, sha256({norm('prompt')}) AS hash FROM source_rows")
def sca3(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").select("row_id", text.prompt_hash(F.col("prompt")).alias("hash"))


@query("sca4_shingles", f"WITH n AS (SELECT item_id, {sql_words(norm('text'))} AS w FROM benchmark_items) SELECT DISTINCT item_id, unnest({sql_grams('w', 13)}) AS shingle FROM n")
def sca4(spark: SparkSession, d: str) -> DataFrame:
    return text.explode_once(load(spark, d, "benchmark_items"), text.shingles(text.normalize(F.col("text"))), "shingle", "item_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents and benchmark items that share a run of eight words."""
    texts, items = (load(spark, d, n).filter("text is not null").select(k, text.normalize(F.col("text")).alias("t")) for n, k in (("documents", "doc_id"), ("benchmark_items", "item_id")))
    return contamination.candidate_texts(texts, items, 8)


_SHARED = f"""WITH a AS (SELECT doc_id AS left_id, {norm('text')} AS p FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id AS right_id, {norm('text')} AS q FROM benchmark_items WHERE text IS NOT NULL),
ag AS (SELECT DISTINCT left_id, unnest({sql_grams(sql_words('p'), 8)}) AS g FROM a), bg AS (SELECT DISTINCT right_id, unnest({sql_grams(sql_words('q'), 8)}) AS g FROM b),
l AS (SELECT DISTINCT left_id, right_id, p, q FROM ag JOIN bg USING (g) JOIN a USING (left_id) JOIN b USING (right_id))"""


@query("sca5_jaccard", f"{_SHARED}, g AS (SELECT left_id, right_id, list_distinct({sql_grams(sql_words('p'), 3)}) AS a, list_distinct({sql_grams(sql_words('q'), 3)}) AS b FROM l) SELECT left_id, right_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS score FROM g")
def sca5(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("left_id", "right_id", text.shingles(F.col("p"), 3).alias("a"), text.shingles(F.col("q"), 3).alias("b"))
    return p.select("left_id", "right_id", F.round(text.jaccard(F.col("a"), F.col("b")), 9).alias("score"))


@query("sca6_containment", f"{_SHARED} SELECT left_id, right_id, (least(length(p), length(q)) >= 48 AND (contains(p, q) OR contains(q, p))) AS contained FROM l")
def sca6(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("left_id", "right_id", text.contained(F.col("p"), F.col("q")).alias("contained"))


_COMPETING_SQL = prompts.COMPETING.replace("'", "''")
_SUFFIX_SQL = prompts.BOXED_SUFFIX.strip().replace("'", "''")
_COUNT_SQL = f"len(regexp_extract_all(CASE WHEN domain IN ('math', 'science') THEN replace(prompt, '{_SUFFIX_SQL}', ' ') ELSE prompt END, '(?i){_COMPETING_SQL}'))"


@query("sca11_competing_count", f"SELECT row_id, CAST({_COUNT_SQL} AS INTEGER) AS n FROM source_rows WHERE prompt IS NOT NULL AND domain IS NOT NULL")
def sca11(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").filter("prompt is not null and domain is not null")
    return rows.select("row_id", prompts.competing_count(F.col("prompt"), F.col("domain")).alias("n"))


@query("flt12_clean_prompts", f"SELECT row_id FROM source_rows WHERE prompt IS NOT NULL AND domain IS NOT NULL AND {_COUNT_SQL} = 0")
def flt12(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").filter("prompt is not null and domain is not null")
    return rows.filter(prompts.competing_count(F.col("prompt"), F.col("domain")) == 0).select("row_id")


def _rate_sql(n: int) -> str:
    w = sql_words(norm("text"))
    return f"WITH g AS (SELECT doc_id, {w} AS w FROM documents), h AS (SELECT doc_id, len(w) AS n, {sql_grams('w', n)} AS g FROM g) SELECT doc_id, CASE WHEN n < {n} THEN 0.0 ELSE round((len(g) - len(list_distinct(g)))::DOUBLE / len(g), 9) END AS rate FROM h WHERE n IS NOT NULL"


@query("sca13_repetition_rate", _rate_sql(4))
def sca13(spark: SparkSession, d: str) -> DataFrame:
    w = F.filter(F.split(text.normalize(F.col("text")), " "), lambda x: x != "")
    rows = spread(load(spark, d, "documents").filter("text is not null").select("doc_id", "text")).select("doc_id", w.alias("w"))
    return rows.select("doc_id", F.round(text.repetition_rate(F.col("w"), 4), 9).alias("rate"))


@query("sca14_reasoning_answer", f"SELECT response_id, CASE WHEN contains(teacher_response, '</think>') THEN replace(split_part(teacher_response, '</think>', 1), '<think>', '') WHEN teacher_response IS NOT NULL THEN '' END AS reasoning, CASE WHEN contains(teacher_response, '</think>') THEN substr(teacher_response, instr(teacher_response, '</think>') + 8) ELSE teacher_response END AS answer FROM {RESPONSES}")
def sca14(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("teacher_response")
    return responses(spark, d).select("response_id", text.reasoning(r).alias("reasoning"), text.answer(r).alias("answer"))


@query("sca15_strip_wrapper", "SELECT item_id, trim(substr(text, 1, length(text) - length(regexp_extract(text, '[^.]*$')) - 1)) AS bare FROM benchmark_items WHERE contains(text, '.') AND NOT contains(text, 'final integer.')")
def sca15(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark_items").filter(F.contains("text", F.lit(".")) & ~F.contains("text", F.lit("final integer.")))
    return rows.select("item_id", text.strip_wrapper(F.col("text"), "final integer.", ".").alias("bare"))


@query("sca16_unwrap_answer", "SELECT item_id, CASE item_id % 5 WHEN 1 THEN CASE WHEN regexp_matches(answer, '^(0|[1-9][0-9]*)$') THEN answer ELSE '[' || answer || ', 2]' END WHEN 3 THEN '{\"v\": \"' || answer || '\"}' WHEN 4 THEN '[]' ELSE answer END AS bare FROM benchmark_items")
def sca16(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a list of one text, a list of two values, with spaces, as an object, and an empty list."""
    k, a = F.col("item_id") % 5, F.col("answer")
    said = F.when(k == 0, F.concat(F.lit(' ["'), a, F.lit('"]'))).when(k == 1, F.concat(F.lit("["), a, F.lit(", 2]"))).when(k == 2, F.concat(F.lit(" "), a, F.lit("\n")))
    said = said.when(k == 3, F.concat(F.lit('{"v": "'), a, F.lit('"}'))).otherwise("[]")
    return load(spark, d, "benchmark_items").select("item_id", text.unwrap_answer(said).alias("bare"))


@query("sca17_reconstruct_question", "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN coalesce(domain, '') || prompt || coalesce(source, '') ELSE coalesce(source, '') || prompt || coalesce(source_id, '') END AS question FROM source_rows")
def sca17(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").withColumn("mode", F.when(F.col("row_id") % 2 == 0, "exact").otherwise("canonical"))
    return rows.select("row_id", text.reconstruct_question(F.col("mode"), F.col("prompt"), F.col("source"), F.col("source_id"), F.col("domain"), F.col("source")).alias("question"))


@query("sca18_constraint_count", "SELECT sample_id, CAST(len(list_filter(string_split(concat(coalesce(difficulty, ' '), chr(9), coalesce(topic, ''), chr(9), domain), chr(9)), lambda x: trim(x) <> '')) AS INTEGER) AS n FROM (SELECT DISTINCT sample_id, difficulty, topic, domain FROM recovery_pool)")
def sca18(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "recovery_pool").select("sample_id", "difficulty", "topic", "domain").distinct()
    joined = F.concat(F.coalesce("difficulty", F.lit(" ")), F.lit("\t"), F.coalesce("topic", F.lit("")), F.lit("\t"), F.coalesce("domain", F.lit("")))
    return rows.select("sample_id", text.constraint_count(joined).alias("n"))


_IDS = ["count:words", "letters:first", "count:lines", "format:title-case", "repeat:span", "letters:last"]


@query("sca19_constraint_families", f"SELECT row_id, array_to_string(list_sort(list_distinct(list_transform([{', '.join(chr(39) + i + chr(39) for i in _IDS)}][1 + row_id % 3:1 + row_id % 3 + row_id % 4 - 1], lambda i: split_part(i, ':', 1)))), ',') AS families FROM source_rows")
def sca19(spark: SparkSession, d: str) -> DataFrame:
    """Families of the ids in a list written out as Python writes it, single quotes and None included."""
    ids = F.slice(F.array(*map(F.lit, _IDS)), (F.col("row_id") % 3 + 1).cast("int"), (F.col("row_id") % 4).cast("int"))
    written = F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("{'instruction_id': ['"), i, F.lit("'], 'kwargs': [None]}"))), ", "), F.lit("]"))
    return load(spark, d, "source_rows").select("row_id", F.array_join(text.constraint_families(written), ",").alias("families"))


_BOXED_SQL = r"CASE WHEN contains(teacher_response, '\boxed{') THEN nullif(regexp_extract(list_last(string_split(teacher_response, '\boxed{')), '^((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1), '') END"


@query("sca20_boxed", f"SELECT response_id, {_BOXED_SQL} AS boxed FROM {RESPONSES}")
def sca20(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("response_id", F.nullif(text.boxed(F.col("teacher_response")), F.lit("")).alias("boxed"))


@query("sca21_normalize_number", r"WITH b AS (SELECT item_id, regexp_replace(concat('$ ', answer, ' '), '[\s,$]', '', 'g') AS x FROM benchmark_items WHERE answer IS NOT NULL) SELECT item_id, CASE WHEN regexp_full_match(x, '[+-]?\d+') THEN CAST(CAST(x AS HUGEINT) AS VARCHAR) ELSE lower(x) END AS normalized FROM b")
def sca21(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "benchmark_items").filter("answer is not null")
    return rows.select("item_id", text.normalize_number(F.concat(F.lit("$ "), "answer", F.lit(" "))).alias("normalized"))


@query("sca22_final_letter", rf"WITH r AS (SELECT response_id, upper(teacher_response) AS t, upper({_BOXED_SQL}) AS b FROM {RESPONSES}) SELECT response_id, CASE WHEN coalesce(regexp_extract(b, '^\W*([ABCD])\W*$', 1), '') <> '' THEN regexp_extract(b, '^\W*([ABCD])\W*$', 1) ELSE list_last(regexp_extract_all(regexp_replace(t, '[^\p{{L}}\p{{N}}_]', '  ', 'g'), '(?:^| )([ABCD])(?: |$)', 1)) END AS letter FROM r")
def sca22(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("response_id", text.final_letter(F.col("teacher_response")).alias("letter"))


@query("sca23_extract_code", f"SELECT response_id, coalesce(list_last(regexp_extract_all(teacher_response, '(?is)```(?:python)?\\s*(.*?)```', 1)), teacher_response) AS code FROM {RESPONSES}")
def sca23(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("response_id", text.extract_code(F.col("teacher_response")).alias("code"))


@query("sca25_sample_id", "SELECT row_id, concat('sft_', domain, '_', substr(sha256(concat_ws(':', 'sft', source, source_id)), 1, 16)) AS sample_id FROM source_rows WHERE domain IS NOT NULL AND source_id IS NOT NULL")
def sca25(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").filter("domain is not null and source_id is not null")
    return rows.select("row_id", text.sample_id(F.lit("sft"), F.col("domain"), F.col("source"), F.col("source_id")).alias("sample_id"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE contains(text, 'val-topk/overlap_ratio:')"


@query("sca26_parse_metric_line", f"WITH l AS ({_LINES}) SELECT doc_id, CAST(regexp_extract(line, '^step:(\\d+)', 1) AS BIGINT) AS step, round(CAST(regexp_extract(line, 'val-topk/overlap_ratio:([0-9.]+)', 1) AS DOUBLE), 9) AS value FROM l WHERE regexp_matches(line, '^step:\\d+ .*val-topk/overlap_ratio:[0-9.]+')")
def sca26(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "documents").filter(F.contains("text", F.lit("val-topk/overlap_ratio:"))).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    parsed = lines.filter(F.col("line").rlike(r"^step:\d+ .*val-topk/overlap_ratio:[0-9.]+"))
    return parsed.select("doc_id", F.regexp_extract("line", r"^step:(\d+)", 1).cast("bigint").alias("step"), F.round(text.metric_value(F.col("line"), "val-topk/overlap_ratio"), 9).alias("value"))


def _role_sql(role: str, sep: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter(messages, lambda m: lower(trim(m.role)) = '{role}'), lambda m: coalesce(m.content, '')), '{sep}'), '')"


@query("sca27_role_texts", f"SELECT DISTINCT response_id, {_role_sql('user', ' ')} AS user_text, {_role_sql('assistant', '')} AS assistant_text FROM teacher_responses WHERE len(messages) > 0")
def sca27(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return load(spark, d, "teacher_responses").filter("size(messages) > 0").select("response_id", text.messages_text(m, "user", " ").alias("user_text"), text.messages_text(m, "assistant", "").alias("assistant_text")).distinct()


@query("flt3_first_content", "SELECT DISTINCT response_id, list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[1].content AS first_user, list_filter(messages, lambda m: lower(trim(m.role)) = 'system')[1].content AS first_system FROM teacher_responses")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return load(spark, d, "teacher_responses").select("response_id", text.first_content(m, "user").alias("first_user"), text.first_content(m, "system").alias("first_system")).distinct()


_WORDS = sql_words(norm("text"))


@query("sca29_response_mask", f"SELECT item_id, array_to_string(list_concat(list_transform(range(len({_WORDS})), lambda i: '0'), list_transform(range(3), lambda i: '1'))[1:40], '') AS mask FROM benchmark_items")
def sca29(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.filter(F.split(text.normalize(F.col("text")), " "), lambda w: w != ""))
    mask = F.slice(F.concat(F.array_repeat(F.lit("0"), n), F.array_repeat(F.lit("1"), 3)), 1, 40)
    return load(spark, d, "benchmark_items").select("item_id", F.array_join(mask, "").alias("mask"))


@query("sca30_loss_mask", "WITH t AS (SELECT response_id, min(messages) AS messages FROM teacher_responses WHERE len(messages) > 0 GROUP BY response_id), e AS (SELECT response_id, unnest(range(len(messages))) AS turn, messages FROM t), w AS (SELECT response_id, turn, lower(trim(messages[turn + 1].role)) AS role, len(list_filter(string_split(" + norm("coalesce(messages[turn + 1].content, '')") + ", ' '), lambda w: w <> '')) AS n FROM e) SELECT response_id, turn::INTEGER AS turn, role, n::INTEGER AS n_tokens, CASE WHEN role = 'assistant' THEN n::INTEGER ELSE 0 END AS n_trained FROM w")
def sca30(spark: SparkSession, d: str) -> DataFrame:
    """Tokens (words) of every turn and how many of them carry loss: those of the assistant."""
    t = load(spark, d, "teacher_responses").filter("size(messages) > 0").groupBy("response_id").agg(F.min("messages").alias("messages"))
    e = t.select("response_id", F.posexplode("messages").alias("turn", "m"))
    n = F.size(F.filter(F.split(text.normalize(F.coalesce("m.content", F.lit(""))), " "), lambda w: w != ""))
    e = e.select("response_id", "turn", F.lower(F.trim("m.role")).alias("role"), n.alias("n_tokens"))
    return e.withColumn("n_trained", F.when(F.col("role") == "assistant", F.col("n_tokens")).otherwise(0))


@query("sca31_truncate_tokens", f"WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark_items) SELECT item_id, array_to_string(CASE WHEN len(w) > 20 THEN w[len(w) - 19:] ELSE w END, ' ') AS kept_left, array_to_string(w[1:20], ' ') AS kept_right, array_to_string(CASE WHEN len(w) > 20 THEN list_concat(w[1:10], w[len(w) - 9:]) ELSE w END, ' ') AS kept_middle FROM w")
def sca31(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "benchmark_items").select("item_id", F.filter(F.split(text.normalize(F.col("text")), " "), lambda w: w != "").alias("w"))
    return w.select("item_id", *[F.array_join(text.truncate_tokens(F.col("w"), 20, s), " ").alias(f"kept_{s}") for s in ("left", "right", "middle")])


@query("sca32_media_parts", "SELECT item_id, 3 AS n_parts, 'text,image,text' AS kinds FROM benchmark_items WHERE length(text) > 0")
def sca32(spark: SparkSession, d: str) -> DataFrame:
    parts = text.media_parts(F.concat("text", F.lit("<image>"), "text"))
    return load(spark, d, "benchmark_items").filter("length(text) > 0").select("item_id", F.size(parts).alias("n_parts"), F.array_join(F.transform(parts, lambda p: p["type"]), ",").alias("kinds"))
