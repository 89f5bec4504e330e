"""Contamination, sampling, splits and the pool-building recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.operators import contamination, sampling
from loomspark.plans.q_text import norm, sql_grams, sql_words
from loomspark.plans.registry import query
from loomspark.session import checkpoint, load
from loomspark.sources import files

_MATCHES = f"""p AS (SELECT row_id AS prompt_id, {norm('prompt')} AS p FROM source_rows WHERE prompt IS NOT NULL),
pw AS (SELECT prompt_id, p, {sql_words('p')} AS w FROM p), ps AS (SELECT prompt_id, p, list_distinct({sql_grams('w', 13)}) AS s FROM pw),
b AS (SELECT item_id, benchmark, benchmark_index, {norm('text')} AS b FROM benchmark_items WHERE text IS NOT NULL),
bw AS (SELECT *, {sql_words('b')} AS w FROM b), bs AS (SELECT item_id, benchmark, benchmark_index, b, list_distinct({sql_grams('w', 13)}) AS s FROM bw),
pe AS (SELECT prompt_id, unnest(s) AS g FROM ps), be AS (SELECT item_id, unnest(s) AS g FROM bs),
sh AS (SELECT prompt_id, item_id, count(*) AS common FROM pe JOIN be USING (g) GROUP BY ALL),
c AS (SELECT prompt_id, item_id, common FROM sh UNION ALL SELECT prompt_id, item_id, 0 FROM ps, bs WHERE len(bs.s) = 0),
v AS (SELECT c.prompt_id, c.item_id, benchmark, benchmark_index, common, len(ps.s) AS np, len(bs.s) AS nb, least(length(p), length(b)) AS matched_characters, (least(length(p), length(b)) >= 48 AND (contains(p, b) OR contains(b, p))) AS exact FROM c JOIN ps USING (prompt_id) JOIN bs USING (item_id)),
m AS (SELECT prompt_id, item_id, benchmark, benchmark_index, CASE WHEN exact THEN 'exact' ELSE 'near_duplicate' END AS level, CASE WHEN exact THEN 1.0 ELSE round(common::DOUBLE / (np + nb - common), 4) END AS score, matched_characters FROM v WHERE exact OR (common > 0 AND common::DOUBLE / (np + nb - common) >= 0.6))"""


#: The prompts, and beside them the items themselves: some with words around them, some with other words at both ends.
_PLANTED = "(SELECT row_id, prompt FROM source_rows UNION ALL SELECT -1 - item_id, CASE item_id % 3 WHEN 0 THEN concat('Now: ', text, ' So it ends.') WHEN 1 THEN concat('Then', substr(text, 20), ' and so on') ELSE substr(text, 200) END FROM benchmark_items WHERE text IS NOT NULL)"
_PLANTED_MATCHES = _MATCHES.replace("FROM source_rows WHERE prompt", f"FROM {_PLANTED} WHERE prompt")


def planted_matches(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "benchmark_items")
    k = F.col("item_id") % 3
    said = F.when(k == 0, F.concat(F.lit("Now: "), "text", F.lit(" So it ends."))).when(k == 1, F.concat(F.lit("Then"), F.expr("substr(text, 20)"), F.lit(" and so on"))).otherwise(F.expr("substr(text, 200)"))
    rows = load(spark, d, "source_rows").select("row_id", "prompt").unionByName(items.filter("text is not null").select((-1 - F.col("item_id")).alias("row_id"), said.alias("prompt")))
    return contamination.contamination_matches(rows, items, "row_id", "prompt")


#: Documents against the items: the same operator where many texts do hold items.
_DOC_MATCHES = _MATCHES.replace("row_id", "doc_id").replace("source_rows", "documents").replace("norm", "norm").replace("(prompt)", "(text)").replace("lower(prompt)", "lower(text)").replace("WHERE prompt IS", "WHERE text IS")


def doc_matches(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contamination_matches(load(spark, d, "documents"), load(spark, d, "benchmark_items"), "doc_id", "text")


_MATCH_COLUMNS = "prompt_id, item_id, benchmark, benchmark_index, level, score, matched_characters"


@query("join1_contamination", f"WITH {_DOC_MATCHES} SELECT {_MATCH_COLUMNS} FROM m")
def join1(spark: SparkSession, d: str) -> DataFrame:
    return doc_matches(spark, d)


@query("join2_short_items", f"WITH {_DOC_MATCHES} SELECT m.prompt_id, m.item_id FROM m JOIN bs USING (item_id) WHERE len(bs.s) = 0")
def join2(spark: SparkSession, d: str) -> DataFrame:
    """Matches of items too short for a shingle."""
    items = load(spark, d, "benchmark_items")
    short = items.withColumn("n", F.size(F.filter(F.split(text.normalize(F.col("text")), " "), lambda w: w != ""))).filter("n < 13").drop("n")
    return contamination.contamination_matches(load(spark, d, "documents"), short, "doc_id", "text").select("prompt_id", "item_id")


@query("con_source_rows", f"WITH {_PLANTED_MATCHES} SELECT {_MATCH_COLUMNS} FROM m")
def con_source_rows(spark: SparkSession, d: str) -> DataFrame:
    return planted_matches(spark, d)


@query("win4_strongest_match", f"WITH {_DOC_MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, benchmark, benchmark_index, item_id) AS k, count(*) OVER (PARTITION BY prompt_id) AS total_matches FROM m) SELECT {_MATCH_COLUMNS}, total_matches FROM r WHERE k = 1")
def win4(spark: SparkSession, d: str) -> DataFrame:
    return contamination.strongest(doc_matches(spark, d))


@query("flt5_contamination_split", f"WITH {_DOC_MATCHES} SELECT doc_id, doc_id IN (SELECT prompt_id FROM m) AS rejected FROM documents")
def flt5(spark: SparkSession, d: str) -> DataFrame:
    hit = doc_matches(spark, d).select(F.col("prompt_id").alias("doc_id"), F.lit(True).alias("rejected")).distinct()
    return load(spark, d, "documents").select("doc_id").join(hit, "doc_id", "left").fillna(False, ["rejected"])


_REPORT = "SELECT t.benchmark, t.items, coalesce(h.items_hit, 0) AS items_hit, coalesce(prompts_hit, 0) AS prompts_hit, coalesce(exact_hits, 0) AS exact_hits, coalesce(near_hits, 0) AS near_hits, coalesce(short_hits, 0) AS short_hits, coalesce(hit_indices, '') AS hit_indices, round(coalesce(items_hit, 0)::DOUBLE / t.items, 9) AS hit_share FROM (SELECT benchmark, count(*) AS items FROM benchmark_items GROUP BY benchmark) t LEFT JOIN (SELECT benchmark, count(DISTINCT benchmark_index) AS items_hit, count(DISTINCT prompt_id) AS prompts_hit, count(*) FILTER (level = 'exact') AS exact_hits, count(*) FILTER (level = 'near_duplicate') AS near_hits, count(*) FILTER (matched_characters < 200) AS short_hits, array_to_string(list_sort(list(DISTINCT benchmark_index)), ',') AS hit_indices FROM m GROUP BY benchmark) h USING (benchmark)"


@query("agg3_contamination_report", f"WITH {_DOC_MATCHES} {_REPORT}")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contamination_report(doc_matches(spark, d), load(spark, d, "benchmark_items"))


@query("rcp2_contamination_scan", f"WITH {_PLANTED_MATCHES} {_REPORT}")
def rcp2(spark: SparkSession, d: str) -> DataFrame:
    return contamination.contamination_report(planted_matches(spark, d), load(spark, d, "benchmark_items"))


@query("agg15_disjointness", f"WITH h AS (SELECT DISTINCT split IN ('sft') AS s, sha256({norm('prompt')}) AS h FROM recovery_pool WHERE prompt IS NOT NULL AND split IN ('sft', 'opd')) SELECT count(DISTINCT h) FILTER (s) AS left_prompts, count(DISTINCT h) FILTER (NOT s) AS right_prompts, (SELECT count(*) FROM (SELECT h FROM h WHERE s INTERSECT SELECT h FROM h WHERE NOT s)) AS overlap FROM h")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool")
    return contamination.disjointness(pool.filter("split = 'sft'"), pool.filter("split = 'opd'"), "prompt")


_KEYED = f"(SELECT *, {norm('prompt')} AS key FROM source_rows WHERE prompt IS NOT NULL)"


@query("win1_keep_first", f"SELECT row_id, key FROM {_KEYED} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, row_id) = 1")
def win1(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").filter("prompt is not null").select("row_id", "ord", text.normalize(F.col("prompt")).alias("key"))
    return sampling.keep_first(rows, ["key"], ["ord", "row_id"]).select("row_id", "key")


_RANK = "sha256(concat_ws(':', '{seed}', coalesce(source, ''), coalesce(source_id, ''), coalesce(substr(prompt, 1, 256), '')))"


def rank_of(seed: str):  # noqa: ANN201
    return sampling.row_rank(seed, F.col("source"), F.col("source_id"), F.col("prompt"))


@query("srt1_stable_rank", f"SELECT row_id, {_RANK.format(seed='pool')} AS rank FROM source_rows")
def srt1(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").select("row_id", rank_of("pool").alias("rank"))


@query("srt2_split_rank", "SELECT DISTINCT sample_id, sha256(concat('7:', sample_id)) AS rank FROM recovery_pool")
def srt2(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").select("sample_id", sampling.stable_rank("7", F.col("sample_id")).alias("rank")).distinct()


@query("srt3_exact_quota", f"SELECT row_id, row_number() OVER (ORDER BY {_RANK.format(seed='q')}, row_id) AS position FROM source_rows QUALIFY position <= 100")
def srt3(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(load(spark, d, "source_rows"), 100, rank_of("q"), tie="row_id").select("row_id", "position")


_STRATUM = "coalesce(strata['difficulty'], '')"


@query("win2_stratified_quota", f"WITH t AS (SELECT row_id, {_STRATUM} AS stratum, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY {_RANK.format(seed='w')}, row_id) AS turn FROM source_rows) SELECT row_id, row_number() OVER (ORDER BY turn, stratum) AS position FROM t QUALIFY position <= 150")
def win2(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(load(spark, d, "source_rows"), 150, rank_of("w"), F.try_element_at("strata", F.lit("difficulty")), "row_id").select("row_id", "position")


@query("win3_interleave", f"SELECT row_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_RANK.format(seed='i')}, row_id) AS turn FROM source_rows")
def win3(spark: SparkSession, d: str) -> DataFrame:
    return sampling.interleave(load(spark, d, "source_rows"), "domain", rank_of("i"), "row_id").select("row_id", "domain", "turn")


_POOL = "(SELECT DISTINCT sample_id, domain FROM recovery_pool WHERE sample_id IS NOT NULL)"


def pool_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "recovery_pool").filter("sample_id is not null").select("sample_id", "domain").distinct()


@query("srt4_first_n_split", f"SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sha256(concat('s:', sample_id)), sample_id) <= 400 THEN 'sft' ELSE 'opd' END AS part FROM {_POOL}")
def srt4(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_n_split(pool_ids(spark, d), 400, sampling.stable_rank("s", F.col("sample_id")), "sample_id").select("sample_id", "part")


@query("rcp5_split_pool", f"WITH s AS (SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sha256(concat('s:', sample_id)), sample_id) <= 400 THEN 'sft' ELSE 'opd' END AS part FROM {_POOL}) SELECT part, count(*) AS n, count(DISTINCT sample_id) AS ids, (SELECT count(*) FROM (SELECT sample_id FROM s WHERE part = 'sft' INTERSECT SELECT sample_id FROM s WHERE part = 'opd')) AS shared FROM s GROUP BY part")
def rcp5(spark: SparkSession, d: str) -> DataFrame:
    s = srt4(spark, d)
    shared = s.filter("part = 'sft'").select("sample_id").intersect(s.filter("part = 'opd'").select("sample_id")).agg(F.count("*").alias("shared"))
    return s.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("ids")).crossJoin(F.broadcast(shared))


_BALANCED = f"WITH n AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS k, count(*) OVER () AS c FROM (SELECT DISTINCT domain FROM {_POOL} WHERE domain IS NOT NULL)), r AS (SELECT sample_id, domain, row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('c:', sample_id)), sample_id) AS r FROM {_POOL}) SELECT sample_id, domain FROM r JOIN n USING (domain) WHERE r <= 102 // c + CASE WHEN k < 102 % c THEN 1 ELSE 0 END"


@query("srt5_balanced_sample", _BALANCED)
def srt5(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced_sample(pool_ids(spark, d), 102, "domain", sampling.stable_rank("c", F.col("sample_id")), "sample_id")


@query("rcp4_calibration_sample", f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sample_id) - 1 AS place FROM ({_BALANCED})), b AS (SELECT domain, place // 1024 AS block, count(*) AS n, sha256(string_agg(sample_id, chr(10) ORDER BY place)) AS d FROM s GROUP BY domain, block) SELECT domain, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY domain")
def rcp4(spark: SparkSession, d: str) -> DataFrame:
    s = checkpoint(sampling.interleave(srt5(spark, d), "domain", F.col("sample_id"), None).withColumn("place", F.col("turn") - 1))
    return files.ordered_digest(s, "sample_id", "place", ["domain"]).join(s.groupBy("domain").agg(F.count("*").alias("n")), "domain").select("domain", "n", "digest")


@query("srt6_up_to_n", f"SELECT sample_id, domain FROM {_POOL} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sha256(concat('u:', sample_id)), sample_id) <= 60")
def srt6(spark: SparkSession, d: str) -> DataFrame:
    return sampling.up_to_n(pool_ids(spark, d), 60, "domain", sampling.stable_rank("u", F.col("sample_id")), "sample_id")


@query("srt7_strided_shard", "SELECT row_id FROM source_rows WHERE ord % 8 = 3")
def srt7(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").filter("ord % 8 = 3").select("row_id")


@query("srt8_head", "SELECT item_id FROM benchmark_items ORDER BY benchmark, benchmark_index LIMIT 25")
def srt8(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark_items").orderBy("benchmark", "benchmark_index").limit(25).select("item_id")


@query("srt9_date_desc", "SELECT row_id, row_number() OVER (ORDER BY CAST(fetched_at AS DATE) DESC NULLS LAST, ord, row_id) AS place FROM source_rows")
def srt9(spark: SparkSession, d: str) -> DataFrame:
    """The place of every row, the newest day first and as encountered within a day."""
    rows = load(spark, d, "source_rows").select("row_id", "ord", F.coalesce(-F.unix_date(F.to_date("fetched_at")), F.lit(1 << 30)).alias("age"))
    return sampling.global_rank(rows, ["age", "ord", "row_id"], "place").select("row_id", (F.col("place") + 1).alias("place"))


@query("flt4_date_window", "SELECT row_id FROM source_rows WHERE substr(CAST(fetched_at AS VARCHAR), 1, 10) BETWEEN '2025-03-05' AND '2025-03-09'")
def flt4(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_rows").filter("fetched_at >= timestamp'2025-03-05' and fetched_at < timestamp'2025-03-10'").select("row_id")


@query("srt17_reverse_index", "SELECT row_id, row_number() OVER (ORDER BY ord, row_id) - 1 AS old_place, ord AS new_place FROM source_rows")
def srt17(spark: SparkSession, d: str) -> DataFrame:
    """The inverse of a permutation of all rows, which is checked to be one."""
    rows = sampling.inverse_permutation(load(spark, d, "source_rows").select("row_id", "ord"), "ord", "row_id", "old_place")
    return rows.select("row_id", "old_place", F.col("ord").alias("new_place"))


_ORDERS = {"random": "sha256(concat('r:', row_id))", "sequential": "lpad(ord::VARCHAR, 20, '0')", "curriculum": "concat(CASE lower(strata['difficulty']) WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 WHEN 'very_hard' THEN 3 ELSE 4 END, ':', sha256(concat('r:', row_id)))"}


@query("srt19_sampler_order", " UNION ALL ".join(f"SELECT '{name}' AS sampler, row_id, row_number() OVER (ORDER BY {key}, row_id) AS place FROM source_rows" for name, key in _ORDERS.items()))
def srt19(spark: SparkSession, d: str) -> DataFrame:
    """The order in which each sampler delivers all rows: at random, as they came, from easy to hard."""
    rows = load(spark, d, "source_rows").select("row_id", "ord", F.lower(F.try_element_at("strata", F.lit("difficulty"))).alias("level"))
    draw = sampling.stable_rank("r", F.col("row_id"))
    step = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("easy", "medium", "hard", "very_hard"))), F.col("level")), F.lit(0)) - 1, F.lit(4))
    keys = {"random": draw, "sequential": F.lpad(F.col("ord").cast("string"), 20, "0"), "curriculum": F.concat(step.cast("string"), F.lit(":"), draw)}
    parts = [sampling.global_rank(rows.select("row_id", key.alias("key")), ["key", "row_id"], "place").select(F.lit(name).alias("sampler"), "row_id", (F.col("place") + 1).alias("place")) for name, key in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("srt20_latest_checkpoint", "SELECT arg_max(path, step) AS latest, max(step) AS step FROM (SELECT concat('run/checkpoint-', event_id) AS path, event_id AS step FROM events)")
def srt20(spark: SparkSession, d: str) -> DataFrame:
    paths = load(spark, d, "events").select(F.concat(F.lit("run/checkpoint-"), "event_id").alias("path"))
    step = F.regexp_extract("path", r"-(\d+)$", 1).cast("bigint")
    return paths.agg(F.max_by("path", step).alias("latest"), F.max(step).alias("step"))


@query("res10_extract_step", "SELECT event_id, CAST(event_id AS INTEGER) AS step FROM events")
def res10(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/ckpt/global_step_"), "event_id", F.lit("/actor"))
    return load(spark, d, "events").select("event_id", F.regexp_extract(path, r"global_step_(\d+)", 1).cast("int").alias("step"))


@query("src2_systematic_sample", "SELECT row_id FROM source_rows WHERE ord IN (SELECT DISTINCT round_even(i * 2000 / 15.0, 0)::BIGINT FROM range(16) t(i))")
def src2(spark: SparkSession, d: str) -> DataFrame:
    return sampling.systematic_sample(load(spark, d, "source_rows"), "ord", 16, 2000).select("row_id")


_VDC = "list_sum(list_transform(range(32), lambda i: ((k >> i) & 1) * power(0.5, i + 1)))"


@query("src3_van_der_corput", f"SELECT event_id, round({_VDC.replace('k >>', 'event_id >>')}, 12) AS point FROM events")
def src3(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(sampling.van_der_corput(F.col("event_id")), 12).alias("point"))


@query("src4_windows_until", f"WITH r AS (SELECT row_id, source_id, ord // 100 AS k FROM source_rows), v AS (SELECT *, {_VDC} AS turn FROM r), f AS (SELECT source_id, min(turn) AS turn FROM v GROUP BY source_id), c AS (SELECT turn, (SELECT count(*) FROM f WHERE f.turn = t.turn) AS fresh FROM (SELECT DISTINCT turn FROM v) t), o AS (SELECT turn, coalesce(sum(fresh) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY turn) AS number FROM c) SELECT row_id FROM v JOIN o USING (turn) WHERE before < 500 AND number <= 12")
def src4(spark: SparkSession, d: str) -> DataFrame:
    return sampling.windows_until(load(spark, d, "source_rows").select("row_id", "source_id", "ord"), "ord", "source_id", 100, 500, 12).select("row_id")


_DROPPED = f"SELECT count(*) FILTER (NOT kept) AS dropped, count(*) FILTER (kept) AS kept FROM (SELECT {norm('prompt')} NOT IN (SELECT {norm('prompt')} FROM recovery_pool WHERE split = 'sft' AND prompt IS NOT NULL) AS kept FROM recovery_pool WHERE split = 'opd' AND prompt IS NOT NULL)"


@query("flt6_drop_reserved", _DROPPED)
def flt6(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool").filter("prompt is not null")
    opd, sft = pool.filter("split = 'opd'"), pool.filter("split = 'sft'")
    kept = sampling.drop_reserved(opd, sft, "prompt").agg(F.count("*").alias("kept"))
    return opd.agg(F.count("*").alias("all")).crossJoin(F.broadcast(kept)).select((F.col("all") - F.col("kept")).alias("dropped"), "kept")


@query("join3_anti_reserved", f"SELECT DISTINCT sample_id FROM recovery_pool WHERE split = 'opd' AND prompt IS NOT NULL AND {norm('prompt')} NOT IN (SELECT {norm('prompt')} FROM recovery_pool WHERE split = 'sft' AND prompt IS NOT NULL)")
def join3(spark: SparkSession, d: str) -> DataFrame:
    pool = load(spark, d, "recovery_pool").filter("prompt is not null")
    return sampling.drop_reserved(pool.filter("split = 'opd'"), pool.filter("split = 'sft'"), "prompt").select("sample_id").distinct()


@query("set4_primary_wins", f"WITH u AS (SELECT row_id, ord, {norm('prompt')} AS key, CASE WHEN source LIKE 'orchard/%' THEN 0 ELSE 1 END AS p FROM source_rows WHERE prompt IS NOT NULL) SELECT row_id, key FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, ord, row_id) = 1")
def set4(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "source_rows").filter("prompt is not null").select("row_id", "ord", "source", text.normalize(F.col("prompt")).alias("key"))
    own = F.coalesce(F.col("source").startswith("orchard/"), F.lit(False))
    return sampling.primary_wins(rows.filter(own), rows.filter(~own), ["key"], ["ord", "row_id"]).select("row_id", "key")


DOMAINS = ("math", "code", "science", "instruction_following")
SFT_QUOTA, OPD_QUOTA = 30, 60
_EXTRACT = f"x AS (SELECT row_id, ord, domain, source, source_id, prompt, {norm('prompt')} AS key, {_STRATUM} AS stratum FROM source_rows WHERE prompt IS NOT NULL AND domain IN ('math', 'code', 'science', 'instruction_following') AND length(trim(prompt)) >= 24), dd AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord, row_id) = 1), clean AS (SELECT * FROM dd WHERE row_id NOT IN (SELECT prompt_id FROM m))"


def _picked(split: str, source: str, quota: int) -> str:
    return f"{split}t AS (SELECT *, row_number() OVER (PARTITION BY domain, stratum ORDER BY {_RANK.format(seed=split)}, row_id) AS turn FROM {source}), {split} AS (SELECT row_id, domain, source, source_id, key, row_number() OVER (PARTITION BY domain ORDER BY turn, stratum, row_id) AS position FROM {split}t QUALIFY position <= {quota})"


_POOLS = f"WITH {_MATCHES}, {_EXTRACT}, {_picked('sft', 'clean', SFT_QUOTA)}, rest AS (SELECT * FROM clean WHERE key NOT IN (SELECT key FROM sft)), {_picked('opd', 'rest', OPD_QUOTA)} SELECT 'sft' AS split, row_id, domain, position, concat_ws('_', 'sft', domain, substr(sha256(concat_ws(':', 'sft', source, coalesce(source_id, ''))), 1, 16)) AS sample_id FROM sft UNION ALL SELECT 'opd', row_id, domain, position, concat_ws('_', 'opd', domain, substr(sha256(concat_ws(':', 'opd', source, coalesce(source_id, ''))), 1, 16)) FROM opd"


@query("rcp1_build_pools", _POOLS)
def rcp1(spark: SparkSession, d: str) -> DataFrame:
    """Both pools: extracted, deduplicated, decontaminated, with quotas per domain in turn over strata, disjoint."""
    rows = load(spark, d, "source_rows").filter(F.col("prompt").isNotNull() & F.col("domain").isin(*DOMAINS) & (F.length(F.trim("prompt")) >= 24))
    rows = rows.select("row_id", "ord", "domain", "source", "source_id", "prompt", text.normalize(F.col("prompt")).alias("key"), F.coalesce(F.try_element_at("strata", F.lit("difficulty")), F.lit("")).alias("stratum"))
    rows = checkpoint(sampling.keep_first(rows, ["key"], ["ord", "row_id"]))
    hits = contamination.contamination_matches(rows, load(spark, d, "benchmark_items"), "row_id", "prompt").select(F.col("prompt_id").alias("row_id"))
    clean = checkpoint(rows.join(hits, "row_id", "left_anti"))  # both pools are cut from it
    sft = checkpoint(sampling.quota_by_domain(clean, SFT_QUOTA, "domain", F.col("stratum"), rank_of("sft"), "row_id"))
    rest = clean.join(sft.select("key"), "key", "left_anti")
    opd = sampling.quota_by_domain(rest, OPD_QUOTA, "domain", F.col("stratum"), rank_of("opd"), "row_id")

    def out(pool: DataFrame, split: str) -> DataFrame:
        name = text.sample_id(F.lit(split), F.col("domain"), F.col("source"), F.coalesce("source_id", F.lit("")))
        return pool.select(F.lit(split).alias("split"), "row_id", "domain", "position", name.alias("sample_id"))

    return out(sft, "sft").unionByName(out(opd, "opd"))


@query("flt16_domain_balance", f"SELECT split, domain, count(*) AS n, count(*) = CASE WHEN split = 'sft' THEN {SFT_QUOTA} ELSE {OPD_QUOTA} END AS balanced FROM ({_POOLS}) GROUP BY split, domain")
def flt16(spark: SparkSession, d: str) -> DataFrame:
    n = rcp1(spark, d).groupBy("split", "domain").agg(F.count("*").alias("n"))
    return n.withColumn("balanced", F.col("n") == F.when(F.col("split") == "sft", SFT_QUOTA).otherwise(OPD_QUOTA))


_BUILT = f"SELECT p.*, {norm('r.prompt')} AS key, coalesce(r.strata['difficulty'], '') AS stratum FROM ({_POOLS}) p JOIN source_rows r USING (row_id)"


@query(
    "flt17_pool_gate",
    f"SELECT 'residual_contamination' AS check_name, (WITH {_MATCHES} SELECT count(*) FROM ({_BUILT}) WHERE row_id IN (SELECT prompt_id FROM m)) AS problems, true AS passed UNION ALL SELECT 'splits_disjoint', (SELECT count(*) FROM (SELECT key FROM ({_BUILT}) WHERE split = 'sft' INTERSECT SELECT key FROM ({_BUILT}) WHERE split = 'opd')), true UNION ALL SELECT 'quotas_met', (SELECT count(*) FROM (SELECT split, domain FROM ({_BUILT}) GROUP BY split, domain HAVING count(*) <> CASE WHEN split = 'sft' THEN {SFT_QUOTA} ELSE {OPD_QUOTA} END)), (SELECT count(*) = 0 FROM (SELECT split, domain FROM ({_BUILT}) GROUP BY split, domain HAVING count(*) <> CASE WHEN split = 'sft' THEN {SFT_QUOTA} ELSE {OPD_QUOTA} END)) UNION ALL SELECT 'strata_spread', (SELECT count(*) FROM (SELECT split, domain FROM ({_BUILT}) GROUP BY split, domain HAVING count(DISTINCT stratum) < 2)), (SELECT count(*) = 0 FROM (SELECT split, domain FROM ({_BUILT}) GROUP BY split, domain HAVING count(DISTINCT stratum) < 2))",
)
def flt17(spark: SparkSession, d: str) -> DataFrame:
    """The gate of built pools: no match with an evaluation item left, no prompt in both, quotas met, more than one stratum in each."""
    pools = checkpoint(rcp1(spark, d))
    texts = checkpoint(pools.join(load(spark, d, "source_rows").select("row_id", "prompt", F.coalesce(F.try_element_at("strata", F.lit("difficulty")), F.lit("")).alias("stratum")), "row_id").withColumn("key", text.normalize(F.col("prompt"))))
    residual = contamination.contamination_matches(texts, load(spark, d, "benchmark_items"), "row_id", "prompt").select("prompt_id").distinct()
    keys = texts.select("split", "key")
    quota = F.when(F.col("split") == "sft", SFT_QUOTA).otherwise(OPD_QUOTA)
    n = F.count("*").alias("problems")
    gates = {
        "residual_contamination": residual.agg(n),
        "splits_disjoint": keys.filter("split = 'sft'").select("key").intersect(keys.filter("split = 'opd'").select("key")).agg(n),
        "quotas_met": pools.groupBy("split", "domain").agg(F.count("*").alias("c")).filter(F.col("c") != quota).agg(n),
        "strata_spread": texts.groupBy("split", "domain").agg(F.countDistinct("stratum").alias("c")).filter("c < 2").agg(n),
    }
    out = None
    for name, g in gates.items():
        row = g.select(F.lit(name).alias("check_name"), "problems")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("problems") == 0)
