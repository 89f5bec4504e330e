"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import hidden_duplicates, leaks, mixture, pairs, reading, split_overlap, tokenize
from loomspark.session import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hidden_duplicates.hidden_duplicates(load(spark, d, "source_rows"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return hidden_duplicates.collapsed(load(spark, d, "source_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(load(spark, d, "teacher_responses"), load(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = split_overlap.split_overlaps(load(spark, d, "recovery_pool"))
    return found.select(F.least("eval_id", "train_id").alias("sample_id_a"), F.greatest("eval_id", "train_id").alias("sample_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool")
    return split_overlap.overlap_report(pool, split_overlap.split_overlaps(pool))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.unmet_targets(load(spark, d, "recovery_pool"), load(spark, d, "mix_targets"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture_report(load(spark, d, "recovery_pool"), load(spark, d, "mix_targets"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixture.draw_mixture(load(spark, d, "recovery_pool"), load(spark, d, "mix_targets"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(load(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(load(spark, d, "documents"), load(spark, d, "benchmark_items"))


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.remove_leaks(load(spark, d, "documents"), load(spark, d, "benchmark_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(load(spark, d, "documents"), load(spark, d, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p3_found, p3_report, p4_found, p4_report, p4_sample, p5_ids, p6_found, p6_cleaned, p7_found)}
def _fold(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{S}}]+', '', 'g')"


_KEYS = f"""WITH r AS (SELECT row_id, {_fold('source_id')} AS s, prompt, starts_with(ltrim(prompt, E' \\t\\n\\r'), '{{') AND json_valid(prompt) AS j FROM source_rows WHERE row_id IS NOT NULL AND source_id IS NOT NULL AND regexp_matches(prompt, '[\\p{{L}}\\p{{N}}]')),
m AS (SELECT row_id, s, CASE WHEN j THEN array_to_string(list_sort(list_transform(json_keys(prompt), lambda k: {_fold('k')} || chr(31) || {_fold("json_extract_string(prompt, '$.' || chr(34) || k || chr(34))")})), chr(30)) ELSE {_fold('prompt')} END AS p, j FROM r),
g AS (SELECT *, min(row_id) OVER w AS keep_id, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY s, p, j))"""
#: Pairs of texts by the edit distance of their words, row by row of the table of distances; only pairs are measured of
#: which neither text has more words of its own than edits are allowed.
_ROW = "list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN x[1] ELSE least(acc[j + 1] + 1, acc[j] + (a[x[1]] <> b[j])::INT) END)"
_DISTANCE = f"list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda acc, x: list_transform([{_ROW}], lambda t: list_transform(range(0, len(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda h: t[h + 1] - h))))[1], range(0, len(b) + 1))[len(b) + 1]"
_OVERLAPS = f"""WITH w AS (SELECT DISTINCT sample_id AS id, lower(trim(split)) IN ('val', 'test') AS held, regexp_extract_all(upper(prompt), '[\\p{{L}}\\p{{N}}]+') AS a FROM recovery_pool WHERE sample_id IS NOT NULL AND prompt IS NOT NULL AND lower(trim(split)) IN ('val', 'test', 'sft', 'opd')),
v AS (SELECT * FROM w WHERE len(a) > 0), u AS (SELECT DISTINCT held, a, len(list_distinct(a)) AS n FROM v),
c AS (SELECT x.a AS a, y.a AS b, greatest(len(x.a), len(y.a)) // 6 AS k FROM u x JOIN u y ON x.held AND NOT y.held AND abs(len(x.a) - len(y.a)) <= greatest(len(x.a), len(y.a)) // 6 WHERE greatest(x.n, y.n) - len(list_intersect(x.a, y.a)) <= greatest(len(x.a), len(y.a)) // 6),
m AS (SELECT a, b FROM c WHERE CASE WHEN a = b THEN 0 ELSE {_DISTANCE} END <= k),
o AS (SELECT DISTINCT e.id AS eval_id, t.id AS train_id FROM m JOIN v e ON e.held AND e.a = m.a JOIN v t ON NOT t.held AND t.a = m.b WHERE e.id <> t.id)"""
_LABEL = "lower(regexp_replace({}, '[\\s_\\-]+', '', 'g'))"

ORACLES: dict[str, str] = {
    "p1_found": f"{_KEYS} SELECT DISTINCT keep_id, row_id AS copy_id FROM g WHERE row_id <> keep_id",
    "p1_collapsed": f"{_KEYS} SELECT DISTINCT x.row_id, coalesce(n, 1) AS n_copies FROM source_rows x LEFT JOIN g ON g.row_id = x.row_id WHERE g.row_id IS NULL OR g.row_id = keep_id",
    "p3_found": f"{_OVERLAPS} SELECT DISTINCT least(eval_id, train_id) AS sample_id_a, greatest(eval_id, train_id) AS sample_id_b FROM o",
    "p3_report": f"{_OVERLAPS}, r AS (SELECT sample_id AS id, min(lower(trim(split))) AS split, min(source) AS source FROM recovery_pool WHERE sample_id IS NOT NULL GROUP BY sample_id) SELECT e.split AS eval_split, t.split AS train_split, e.source, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_eval_records FROM o JOIN r e ON e.id = eval_id JOIN r t ON t.id = train_id GROUP BY ALL",
    "p4_found": f"""WITH p AS (SELECT DISTINCT sample_id, lower(trim(split)) AS split, {_LABEL.format('domain')} AS d, {_LABEL.format('difficulty')} AS f, {_LABEL.format('topic')} AS t FROM recovery_pool WHERE sample_id IS NOT NULL),
n AS (SELECT split, count(DISTINCT sample_id) AS r FROM p GROUP BY split),
w AS (SELECT m.*, greatest(floor(round(target_share * floor(round(sample_fraction * coalesce(r, 0), 9)), 9)), min_rows) AS need FROM mix_targets m LEFT JOIN n USING (split))
SELECT target_id FROM w WHERE (SELECT count(DISTINCT sample_id) FROM p WHERE p.split = w.split AND (w.domain IS NULL OR p.d = {_LABEL.format('w.domain')}) AND (w.difficulty IS NULL OR p.f = {_LABEL.format('w.difficulty')}) AND (w.topic IS NULL OR p.t = {_LABEL.format('w.topic')})) < need""",
}
