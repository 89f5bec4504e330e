"""The eight extractors by split and domain, over records made of source_rows in the shape that each reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.registry import EXTRACTORS
from loomspark.operators import extractors as ex
from loomspark.plans import q_prompts as qp
from loomspark.plans.q_text import _COUNT_SQL, norm
from loomspark.plans.registry import query
from loomspark.session import load, spread

_IDS = ["count:word", "format:list", "words:repeats", "format:title-case", "count:numbers", "ratio:overlap"]
#: A record's fields, SQL: most come from the row's number, so that every condition of an extractor meets some rows.
_RECORD = f"""SELECT row_id, ord, domain, source, coalesce(nullif(source_id, ''), row_id::VARCHAR) AS source_id, {qp.WORDED_SQL} AS problem, {qp.WORDED_SQL.replace('prompt', 'messages[1].content')} AS said, row_id % 9 = 0 AS tools, strata['topic'] AS topic,
CASE WHEN row_id % 4 = 0 THEN 'MCQ' ELSE 'OpenQ' END AS question_format, CASE WHEN row_id % 3 = 0 THEN 'mcq' ELSE 'open' END AS question_type, row_id % 6 AS n FROM source_rows"""


def records(spark: SparkSession, d: str, domain: str) -> DataFrame:
    r = load(spark, d, "source_rows").filter(F.col("domain") == domain)
    k = F.col("row_id")
    said = qp.worded_of(F.get("messages", 0)["content"])
    turn = F.struct(F.lit("user").alias("role"), said.alias("content"))
    system = F.struct(F.lit("system").alias("role"), F.when(k % 2 == 0, F.concat(F.lit("Rule "), k.cast("string"))).otherwise(" ").alias("content"))
    ids = F.slice(F.array(*map(F.lit, _IDS)), F.lit(1), (k % 6).cast("int"))
    place = F.when(F.col("ord") % 5 == 0, F.struct(F.lit("contest_a").alias("dataset"), (F.col("ord") % 65).cast("int").alias("row"), F.lit("Q: ").alias("prefix"), F.when(k % 2 == 0, " End.").alias("suffix")))
    r = r.select(
        "row_id", "ord", "source", ex.id_or(F.col("source_id"), k).alias("source_id"), F.coalesce(F.try_element_at("strata", F.lit("subset")), F.lit("")).alias("label"), qp.worded_of(F.col("prompt")).alias("problem"), F.array(system, turn).alias("messages"),
        F.when(k % 9 == 0, F.array(F.lit("python"))).alias("tools"), F.try_element_at("strata", F.lit("topic")).alias("topic"), F.when(k % 4 == 0, "MCQ").otherwise("OpenQ").alias("question_format"), F.when(k % 3 == 0, "mcq").otherwise("open").alias("question_type"),
        F.when(k % 7 == 0, '{"input": ').otherwise(F.to_json(F.struct(F.array(turn).alias("input")))).alias("params"), F.array_join(ids, "\t").alias("constraint"), F.concat(F.lit("[{'instruction_id': ['"), F.array_join(ids, "', '"), F.lit("'], 'kwargs': [None]}]")).alias("ground_truth"), place.alias("place"),
    )
    return spread(r)


def public(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark_items").select(F.col("benchmark").alias("dataset"), F.col("benchmark_index").alias("row"), F.col("text").alias("question"))


EXTRACTORS.register("sft/math")(lambda spark, d: ex.sft_math(records(spark, d, "math")))
EXTRACTORS.register("sft/code")(lambda spark, d: ex.sft_code(records(spark, d, "code")))
EXTRACTORS.register("sft/science")(lambda spark, d: ex.sft_science(records(spark, d, "science")))
EXTRACTORS.register("sft/instruction_following")(lambda spark, d: ex.sft_instructions(records(spark, d, "instruction_following")))
EXTRACTORS.register("opd/math")(lambda spark, d: ex.opd_math(records(spark, d, "math").filter("row_id % 2 = 0"), public(spark, d), records(spark, d, "math").filter("row_id % 2 = 1")))
EXTRACTORS.register("opd/code")(lambda spark, d: ex.opd_code(records(spark, d, "code")))
EXTRACTORS.register("opd/science")(lambda spark, d: ex.opd_science(records(spark, d, "science")))
EXTRACTORS.register("opd/instruction_following")(lambda spark, d: ex.opd_instructions(records(spark, d, "instruction_following")))


def extractors_for(split: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The extractors of a split by domain; an unknown split fails."""
    own = {name.split("/")[1]: f for name, f in EXTRACTORS.items.items() if name.startswith(f"{split}/")}
    if not own:
        raise KeyError(f"no extractors for split {split!r}")
    return own


_S = qp.sql_strip


def _text_sql(rows: str, domain: str, tag: str) -> str:
    """WITH clauses that end in t{tag}(row_id, ord, source, source_id, label, body); `rows` has t for the question."""
    count = _COUNT_SQL.replace("prompt", "aligned").replace("domain", f"'{domain}'")
    return f"""q{tag} AS (SELECT * REPLACE ({_S('t')} AS t) FROM ({rows}) WHERE length({_S('t')}) >= 24), {qp.sql_stripped(f'q{tag}', f'b{tag}')},
u{tag} AS (SELECT row_id, {qp._NO_SUFFIX_SQL} AS t FROM q{tag}), {qp.sql_stripped(f'u{tag}', f'a{tag}')},
t{tag} AS (SELECT q.row_id, ord, source, source_id, label, b.body FROM q{tag} q JOIN b{tag} b USING (row_id) JOIN (SELECT row_id, body || {qp.literal(qp.prompts.BOXED_SUFFIX)} AS aligned FROM a{tag}) a USING (row_id) WHERE length(b.body) >= 24 AND {count} = 0)"""


def _code_sql(rows: str, tag: str) -> str:
    return f"""r{tag} AS ({rows}), c{tag} AS (SELECT row_id, {qp._BARE_SQL} AS t FROM r{tag}), {qp.sql_stripped(f'c{tag}', f'b{tag}')},
t{tag} AS (SELECT r.row_id, ord, source, source_id, label, b.body FROM r{tag} r JOIN b{tag} b USING (row_id) WHERE length(b.body) >= 24)"""


_BY_TEXT = f"QUALIFY row_number() OVER (PARTITION BY {norm('body')} ORDER BY ord, row_id) = 1"
_BY_ID = "QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY ord, row_id) = 1"
_OUT = "row_id, source_id, label, md5(body) AS body_digest"


def _from(domain: str, question: str, where: str = "true", label: str = "coalesce(strata['subset'], '')") -> str:
    return f"SELECT row_id, ord, source, source_id, {label} AS label, {question} AS t FROM ({_RECORD.replace(' FROM source_rows', ', strata, messages FROM source_rows')}) WHERE domain = '{domain}' AND {where}"


_TOPICS = f"topic IN {ex.SCIENCE_TOPICS}"
_SAID = "coalesce(said, '')"
_RULE = "CASE WHEN row_id % 2 = 0 THEN 'Rule ' || row_id ELSE '' END"
_OWN = _from("math", "CASE WHEN ord % 5 = 0 THEN 'Q: ' || text || CASE WHEN row_id % 2 = 0 THEN ' End.' ELSE '' END ELSE problem END", "row_id % 2 = 0", "CASE WHEN ord % 5 = 0 THEN 'contest_a' ELSE 'native' END").replace(") WHERE", ") LEFT JOIN (SELECT benchmark_index, text FROM benchmark_items WHERE benchmark = 'contest_a') b ON b.benchmark_index = ord % 65 WHERE", 1)
_FIRST = f"list_sort(list_distinct([{', '.join(chr(39) + i + chr(39) for i in _IDS)}][1:n]))"
_SQL = {
    "sft/math": f"WITH RECURSIVE {_text_sql(_from('math', 'problem'), 'math', '1')} SELECT {_OUT} FROM t1 {_BY_TEXT}",
    "sft/code": f"WITH RECURSIVE {_code_sql(_from('code', _SAID, 'NOT tools'), '2')} SELECT {_OUT} FROM t2 {_BY_ID}",
    "sft/science": f"WITH RECURSIVE {_text_sql(_from('science', _SAID, _TOPICS + ' AND NOT tools AND question_format = ' + qp.literal('OpenQ')), 'science', '3')} SELECT {_OUT} FROM t3 {_BY_TEXT}",
    "sft/instruction_following": f"WITH t4 AS (SELECT *, t AS body FROM ({_from('instruction_following', _SAID, label=_RULE)}) WHERE length({_S('t')}) >= 24) SELECT {_OUT} FROM t4 {_BY_TEXT}",
    "opd/math": f"WITH RECURSIVE {_text_sql(_OWN, 'math', '5')}, own AS (SELECT * FROM t5 {_BY_TEXT}), {_text_sql(_from('math', 'problem', 'row_id % 2 = 1'), 'math', '6')}, more AS (SELECT * FROM t6 {_BY_TEXT}), both_ AS (SELECT 0 AS p, * FROM own UNION ALL SELECT 1, row_id, ord, source, source_id, 'supplement', body FROM more) SELECT {_OUT} FROM both_ QUALIFY row_number() OVER (PARTITION BY {norm('body')} ORDER BY p, ord, row_id) = 1",
    "opd/code": f"WITH RECURSIVE {_code_sql(_from('code', 'said', 'row_id % 7 <> 0 AND ' + _SAID + ' <> ' + chr(39) * 2), '7')} SELECT {_OUT} FROM t7 {_BY_ID}",
    "opd/science": f"WITH RECURSIVE {_text_sql(_from('science', 'problem', _TOPICS + ' AND question_type = ' + qp.literal('open')), 'science', '8')} SELECT {_OUT} FROM t8 {_BY_TEXT}",
    "opd/instruction_following": f"WITH t9 AS (SELECT *, t AS body FROM ({_from('instruction_following', _SAID, 'n BETWEEN 1 AND 5', f'concat_ws({chr(39)}|{chr(39)}, n, {_FIRST}[1], len({_FIRST}))')}) WHERE length({_S('t')}) >= 24) SELECT {_OUT} FROM t9 {_BY_ID}",
}
_NAMES = {"sft/math": "ext1_math", "sft/code": "ext2_code", "sft/science": "ext3_science", "sft/instruction_following": "ext4_instructions", "opd/math": "ext5_math_supplement", "opd/code": "ext6_code_by_id", "opd/science": "ext7_science_open", "opd/instruction_following": "ext8_instructions_by_id"}
for _key, _name in _NAMES.items():
    query(_name, _SQL[_key])(lambda spark, d, key=_key: EXTRACTORS.get(key)(spark, d).select("row_id", "source_id", "label", F.md5(F.col("body").cast("binary")).alias("body_digest")))


@query("ext9_registry", " UNION ALL ".join(f"SELECT '{k.split('/')[0]}' AS split, '{k.split('/')[1]}' AS domain, count(*) AS n FROM ({sql})" for k, sql in _SQL.items()))
def ext9(spark: SparkSession, d: str) -> DataFrame:
    """Rows by split and domain, each by the extractor that the registry names."""
    counts = [f(spark, d).agg(F.count("*").alias("n")).select(F.lit(split).alias("split"), F.lit(domain).alias("domain"), "n") for split in ("sft", "opd") for domain, f in extractors_for(split).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
