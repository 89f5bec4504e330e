"""Queries over prompt formats: instructions stripped, suffixes aligned, templates and messages.

The prompts of the tables carry few instructions; `worded` puts the usual ones around them, by the row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import prompts
from loomspark.plans.registry import query
from loomspark.session import load, spread

#: Texts before and after the prompt of a row, by its number modulo their count.
AROUND = [
    ("", ""),
    ("Solve the following problem. Make sure to put the answer (and only answer) inside \\boxed{}.\n\n", ""),
    ("", " Present your answer inside \\boxed{}."),
    ("", "\n\nWrite only the answer in \\boxed{}.\n\n\n\nProvide a precise and correct solution using your knowledge."),
    ("Answer: give the result in square brackets.\n", "\nPut \\boxed{}  around the final answer\nThe value \\boxed{7} is used in the answer: give x."),
    (prompts.HARNESS[1] + "\n\n" + prompts.HARNESS[3] + "\n", prompts.BOXED_SUFFIX + prompts.BOXED_SUFFIX),
    ("Answer this question.\r\n", "\nYour answer: use \\boxed{} and $a$ + $b$.\nThink step by step."),
]
STARTER = "class Solution:\n    def solve(self, n: int) -> int:\n"


def literal(x: str) -> str:
    """A text as an SQL expression."""
    return " || ".join("'" + part.replace("'", "''") + "'" for part in x.replace("\r", "\0chr(13)\0").replace("\n", "\0chr(10)\0").split("\0")).replace("'chr(13)'", "chr(13)").replace("'chr(10)'", "chr(10)") if x else "''"


WORDED_SQL = "(CASE row_id % " + str(len(AROUND)) + " " + " ".join(f"WHEN {k} THEN {literal(a)} || prompt || {literal(b)}" for k, (a, b) in enumerate(AROUND)) + " END)"


def worded_of(prompt: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (a, b) in enumerate(AROUND):
        out = F.when(F.col("row_id") % len(AROUND) == k, F.concat(F.lit(a), prompt, F.lit(b))).otherwise(out)
    return out


def rows(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, domain, t): prompts with instructions around them."""
    return spread(load(spark, d, "source_rows").filter("prompt is not null").select("row_id", "domain", worded_of(F.col("prompt")).alias("t")))


ROWS_SQL = f"SELECT row_id, domain, {WORDED_SQL} AS t FROM source_rows WHERE prompt IS NOT NULL"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def sql_instruction(x: str) -> str:
    body = sql_strip(x)
    plain = f"regexp_replace({body}, {_q('(?i)' + prompts.FORMAT_MARKER)}, ' ', 'g')"
    return f"(length({body}) <= {prompts.LONGEST_INSTRUCTION} AND regexp_matches({body}, {_q('(?i)' + prompts.FORMAT_MARKER)}) AND regexp_matches({body}, {_q('(?i)' + prompts.DIRECTIVE)}) AND NOT regexp_matches({body}, {_q(prompts.FILLED_BOX)}) AND length({plain}) - length(replace({plain}, '$', '')) < 2 AND NOT regexp_matches({plain}, {_q(prompts.MATH_MARKUP)}))"


def sql_filler(x: str) -> str:
    return f"regexp_matches({sql_strip(x)}, {_q('(?i)' + prompts.FILLER)})"


def sql_core(source: str, name: str, kept: str) -> str:
    """Rows of `source` with the list `name` from its first to its last element with content; `kept` are further columns."""
    own = f"list_transform({name}, lambda x: NOT ({sql_strip('x')} = '' OR {sql_instruction('x')} OR {sql_filler('x')}))"
    return f"(SELECT {kept}, CASE WHEN list_contains(own, true) THEN {name}[list_position(own, true):len(own) + 1 - list_position(list_reverse(own), true)] ELSE {name}[len({name}):] END AS {name} FROM (SELECT *, {own} AS own FROM {source}))"


def sql_lines(x: str) -> str:
    kept = f"list_filter({x}, lambda y: {sql_strip('y')} <> '' AND NOT {sql_instruction('y')})"
    return f"CASE WHEN len({x}) > 1 AND len({kept}) > 0 THEN {kept} ELSE {x} END"


def _gaps(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]|\\\\\\])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


def sql_stripped(source: str, name: str = "stripped") -> str:
    """WITH clauses that end in `name`(row_id, body), from `source` with (row_id, t)."""
    lines = f"(SELECT row_id, pass, body, {sql_lines('l')} AS l FROM {sql_core('(SELECT row_id, pass, body, string_split(body, chr(10)) AS l FROM ' + f's_{name}' + ' WHERE pass < ' + str(prompts.PASSES) + ' AND NOT done)', 'l', 'row_id, pass, body')})"
    first = sql_core(f"(SELECT *, {_gaps('l[1]')} AS a FROM {lines})", "a", "row_id, pass, body, l")
    shown = f"(SELECT row_id, pass, body, l, {sql_strip(chr(97) + '_')} AS f FROM (SELECT *, array_to_string(a, '') AS a_ FROM {first}))"
    last = sql_core(f"(SELECT *, {_gaps('CASE WHEN len(l) = 1 THEN f ELSE l[len(l)] END')} AS b FROM {shown})", "b", "row_id, pass, body, l, f")
    ends = f"(SELECT row_id, pass, body, CASE WHEN len(l) = 1 THEN [g] ELSE list_concat([f], list_concat(l[2:len(l) - 1], [g])) END AS l FROM (SELECT *, {sql_strip(chr(98) + '_')} AS g FROM (SELECT *, array_to_string(b, '') AS b_ FROM {last})))"
    whole = sql_core(ends, "l", "row_id, pass, body")
    after = sql_strip("regexp_replace(regexp_replace(array_to_string(l, chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
    return f"""s_{name} AS (SELECT row_id, 0 AS pass, replace(t, chr(13) || chr(10), chr(10)) AS body, false AS done FROM {source}
UNION ALL SELECT row_id, pass + 1, after, after = {sql_strip('body')} FROM (SELECT row_id, pass, body, {after} AS after FROM {whole})),
{name} AS (SELECT row_id, {sql_strip('arg_max(body, pass)')} AS body FROM s_{name} GROUP BY row_id)"""


_ANY_HARNESS = "|".join(map(prompts.quoted, prompts.HARNESS))
_BARE_SQL = f"regexp_replace({sql_strip('replace(t, chr(13) || chr(10), chr(10))')}, {_q(f'^(?:(?:{_ANY_HARNESS})[ \\t\\n\\x0b\\f\\r]*)+')}, '')"
_NO_SUFFIX_SQL = f"regexp_replace(t, {_q(f'(?:[ \\t\\n\\x0b\\f\\r]*{prompts.quoted(prompts.BOXED_SUFFIX.strip())}[ \\t\\n\\x0b\\f\\r]*)+$')}, '')"


@query("sca7_strip_instructions", f"WITH RECURSIVE p AS ({ROWS_SQL}), {sql_stripped('p')} SELECT row_id, body AS stripped FROM stripped")
def sca7(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row_id", prompts.strip_column(F.col("t")).alias("stripped"))


_LINES_SQL = f"p AS ({ROWS_SQL}), l AS (SELECT row_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10)))))::INTEGER AS pos FROM p)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row_id", F.posexplode(F.split("t", "\n")).alias("pos", "line"))


@query("sca7a_is_instruction", f"WITH {_LINES_SQL} SELECT row_id, pos FROM l WHERE {sql_instruction('line')}")
def sca7a(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(prompts.instruction_column(F.col("line"))).select("row_id", "pos")


@query("sca7b_peel_boundaries", f"WITH p AS (SELECT row_id, string_split(t, chr(10)) AS l FROM ({ROWS_SQL})) SELECT row_id, array_to_string(l, chr(10)) AS kept FROM {sql_core('p', 'l', 'row_id')}")
def sca7b(spark: SparkSession, d: str) -> DataFrame:
    """Lines left when removable ones at both ends are taken away."""
    return rows(spark, d).select("row_id", F.array_join(prompts.core_column(F.split("t", "\n")), "\n").alias("kept"))


@query("sca7c_interior_lines", f"WITH p AS (SELECT row_id, string_split(t, chr(10)) AS l FROM ({ROWS_SQL})) SELECT row_id, array_to_string({sql_lines('l')}, chr(10)) AS kept FROM p")
def sca7c(spark: SparkSession, d: str) -> DataFrame:
    """Lines of prompts that are no instructions; all of them if none is left."""
    return rows(spark, d).select("row_id", F.array_join(prompts.lines_column(F.split("t", "\n")), "\n").alias("kept"))


@query("sca7d_filler_lines", f"WITH {_LINES_SQL} SELECT row_id, pos FROM l WHERE {sql_filler('line')}")
def sca7d(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(prompts.filler_column(F.col("line"))).select("row_id", "pos")


_SUFFIXED = "CASE WHEN domain = 'instruction_following' THEN '' ELSE " + literal(prompts.BOXED_SUFFIX) + " END"


@query(
    "sca8_align_prompt",
    f"WITH RECURSIVE r AS ({ROWS_SQL} AND domain IN ('math', 'science', 'instruction_following')), p AS (SELECT row_id, CASE WHEN domain = 'instruction_following' THEN t ELSE {_NO_SUFFIX_SQL} END AS t FROM r), {sql_stripped('p')} SELECT row_id, body || {_SUFFIXED} AS aligned FROM stripped JOIN r USING (row_id)",
)
def sca8(spark: SparkSession, d: str) -> DataFrame:
    told = rows(spark, d).filter(F.col("domain").isin("math", "science", "instruction_following"))
    return told.select("row_id", prompts.align_column(F.col("t"), F.col("domain")).alias("aligned"))


_STARTER_SQL = f"(CASE WHEN row_id % 2 = 0 THEN {literal(STARTER)} END)"


def _code_sql(body: str) -> str:
    with_start = f"{literal(prompts.WITH_STARTER + chr(10) + '```python' + chr(10))} || {sql_strip(_STARTER_SQL)} || {literal(chr(10) + '```')}"
    without = literal(prompts.WITHOUT_STARTER + "\n```python\n# YOUR CODE HERE\n```")
    return f"{literal('### Question:' + chr(10))} || {body} || {literal(chr(10) * 2 + '### Format: ')} || CASE WHEN {_STARTER_SQL} IS NULL THEN {without} ELSE {with_start} END || {literal(chr(10) * 2 + '### Answer: (use the provided format with backticks)' + chr(10) * 2)}"


@query("sca9_code_prompt", f"WITH RECURSIVE r AS ({ROWS_SQL} AND domain = 'code'), p AS (SELECT row_id, {_BARE_SQL} AS t FROM r), {sql_stripped('p')} SELECT row_id, {_code_sql('body')} AS code_prompt FROM stripped")
def sca9(spark: SparkSession, d: str) -> DataFrame:
    code = rows(spark, d).filter("domain = 'code'")
    return code.select("row_id", prompts.code_prompt_column(F.col("t"), F.when(F.col("row_id") % 2 == 0, STARTER)).alias("code_prompt"))


@query("sca10_strip_harness", f"WITH p AS ({ROWS_SQL}) SELECT row_id, {_BARE_SQL} AS bare FROM p")
def sca10(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row_id", prompts.strip_harness(F.col("t")).alias("bare"))


@query(
    "sca12_messages_for",
    f"""WITH RECURSIVE r AS ({ROWS_SQL} AND domain IS NOT NULL), p AS (SELECT row_id, CASE domain WHEN 'code' THEN {_BARE_SQL} WHEN 'instruction_following' THEN t ELSE {_NO_SUFFIX_SQL} END AS t FROM r), {sql_stripped('p')}
SELECT row_id, CASE WHEN domain = 'code' THEN 2 ELSE 1 END AS n, sha256(CASE WHEN domain = 'code' THEN {literal('system:' + prompts.CODE_SYSTEM + chr(10))} || 'user:' || {_code_sql('body')} ELSE 'user:' || body || {_SUFFIXED} END) AS digest FROM stripped JOIN r USING (row_id)""",
)
def sca12(spark: SparkSession, d: str) -> DataFrame:
    told = rows(spark, d).filter("domain is not null")
    m = told.select("row_id", prompts.messages_for(F.col("t"), F.col("domain"), F.when(F.col("row_id") % 2 == 0, STARTER)).alias("messages"))
    return m.select("row_id", F.size("messages").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n"), 256).alias("digest"))


@query("flt2_code_rows", f"WITH RECURSIVE r AS ({ROWS_SQL} AND domain = 'code'), p AS (SELECT row_id, {_BARE_SQL} AS t FROM r), {sql_stripped('p')} SELECT row_id FROM stripped WHERE length(body) >= 24")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    code = rows(spark, d).filter("domain = 'code'")
    return code.select("row_id", prompts.strip_column(prompts.strip_harness(F.col("t"))).alias("body")).filter(F.length("body") >= 24).select("row_id")
