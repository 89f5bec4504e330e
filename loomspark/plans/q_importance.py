"""Importance and masks: vectors stand for activations (label: layer, place in the vector: channel)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import importance as im
from loomspark.plans.q_rollouts import _r, rounded
from loomspark.plans.registry import query
from loomspark.session import load

_A = "a AS (SELECT label AS layer, vec_id AS sample, i::INTEGER AS channel, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i))"
_M = f"{_A}, m AS (SELECT layer, channel, sqrt(sum(m * m)) AS score FROM (SELECT layer, channel, sample, avg(abs(x)) AS m FROM a GROUP BY ALL) GROUP BY ALL)"
_N = f"{_A}, n AS (SELECT layer, channel, sqrt(sum(x * x)) AS norm FROM a GROUP BY ALL)"
_W = f"{_N}, w AS (SELECT layer, channel, norm * sqrt(avg(x * x)) AS wanda, greatest(avg(x * x) - pow(avg(x), 2), 0) * norm * norm AS wifv, avg(abs(x)) * norm AS wifn FROM a JOIN n USING (layer, channel) GROUP BY layer, channel, norm)"
_O = f"{_M}, o AS (SELECT layer, channel, row_number() OVER (PARTITION BY layer ORDER BY round(score, 10) DESC, channel) - 1 AS rank FROM m)"
_K = "least(greatest(floor(64 * (1 - {r}) / 8 + 0.5) * 8, 8), 64)"
_MASKS = f"{_O}, k AS (SELECT r AS ratio, layer, channel FROM o, (VALUES (0.15::DOUBLE), (0.25), (0.35)) v(r) WHERE rank < {_K.format(r='r')})"


def acts(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("channel", "x"))
    return e.withColumn("x", F.col("x").cast("double"))


def norms(spark: SparkSession, d: str) -> DataFrame:
    return im.column_norms(acts(spark, d).withColumnRenamed("x", "w"))


def order(spark: SparkSession, d: str) -> DataFrame:
    return im.channel_order(im.minitron(acts(spark, d)).withColumn("score", F.round("score", 10)), "score")


def other_order(spark: SparkSession, d: str) -> DataFrame:
    w = im.activation_statistics(acts(spark, d), norms(spark, d)).withColumn("wanda", F.round("wanda", 10))
    return im.channel_order(w, "wanda")


@query("num2_minitron", f"WITH {_M} SELECT layer, channel, {_r('score', 'score')} FROM m")
def num2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.minitron(acts(spark, d)))


@query("num3_wanda_flap", f"WITH {_W} SELECT layer, channel, {_r('wanda', 'wanda')}, {_r('wifv', 'wifv')}, {_r('wifn', 'wifn')} FROM w")
def num3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.activation_statistics(acts(spark, d), norms(spark, d)))


@query("num4_column_norms", f"WITH {_N} SELECT layer, channel, {_r('norm', 'norm')} FROM n")
def num4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(norms(spark, d))


@query("num5_taylor", f"WITH {_A} SELECT layer, channel, {_r('sum(abs(x * (x - 0.1))) / 4', 'first_order')}, {_r('0.5 * sum(x * (x - 0.1) * x * (x - 0.1)) / 4', 'second_order')} FROM a GROUP BY ALL")
def num5(spark: SparkSession, d: str) -> DataFrame:
    w = acts(spark, d).withColumnRenamed("x", "w").withColumn("g", F.col("w") - 0.1)
    return rounded(im.taylor(w, 4))


@query("win13_channel_order", f"WITH {_O} SELECT layer, channel, rank FROM o")
def win13(spark: SparkSession, d: str) -> DataFrame:
    return order(spark, d)


@query("num6_nested_masks", f"WITH {_MASKS} SELECT ratio, layer, channel FROM k")
def num6(spark: SparkSession, d: str) -> DataFrame:
    return im.nested_masks(order(spark, d), [0.15, 0.25, 0.35], 8)


@query("rcp6_mask_build", f"WITH {_MASKS} SELECT ratio, layer, count(*) AS kept, array_to_string(list_sort(list(channel)), ',') AS channels FROM k GROUP BY ALL")
def rcp6(spark: SparkSession, d: str) -> DataFrame:
    return num6(spark, d).groupBy("ratio", "layer").agg(F.count("*").alias("kept"), F.array_join(F.array_sort(F.collect_list("channel")), ",").alias("channels"))


@query("set7_nesting_check", f"WITH {_MASKS} SELECT count(*) AS violations FROM k b WHERE ratio > 0.15 AND NOT EXISTS (SELECT 1 FROM k a WHERE a.layer = b.layer AND a.channel = b.channel AND a.ratio = CASE WHEN b.ratio = 0.35 THEN 0.25 ELSE 0.15 END)")
def set7(spark: SparkSession, d: str) -> DataFrame:
    return im.nesting_violations(num6(spark, d)).agg(F.count("*").alias("violations"))


_CMP = f"{_W.replace(_A, _O)}, o2 AS (SELECT layer, channel, row_number() OVER (PARTITION BY layer ORDER BY round(wanda, 10) DESC, channel) - 1 AS rank FROM w), c AS (SELECT layer, count(*) FILTER (o.rank >= 48) AS removed_left, count(*) FILTER (o2.rank >= 48) AS removed_right, count(*) FILTER (o.rank >= 48 AND o2.rank >= 48) AS shared FROM o JOIN o2 USING (layer, channel) GROUP BY layer)"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    a, b = order(spark, d), other_order(spark, d)
    return im.compare_masks(im.nested_masks(a, [0.25], 8), im.nested_masks(b, [0.25], 8), a.select("layer", "channel"))


@query("set6_removed_overlap", f"WITH {_CMP} SELECT layer, removed_left, removed_right, shared, {_r('shared / greatest(removed_left, 1)', 'overlap')}, {_r('1 - shared / greatest(removed_left, 1)', 'replacement')} FROM c")
def set6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_compared(spark, d))


@query("agg17_mask_summary", f"WITH {_CMP}, x AS (SELECT layer, 1 - shared / greatest(removed_left, 1) AS replacement FROM c) SELECT {_r('avg(replacement)', 'mean_replacement')}, {_r('max(replacement)', 'max_replacement')}, (SELECT layer FROM x ORDER BY replacement DESC, layer LIMIT 1) AS max_layer FROM x")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_compared(spark, d).agg(F.avg("replacement").alias("mean_replacement"), F.max("replacement").alias("max_replacement"), F.max_by("layer", F.struct("replacement", -F.col("layer"))).alias("max_layer")))


@query("rcp7_compare_masks", f"WITH {_CMP} SELECT layer, {_r('1 - shared / greatest(removed_left, 1)', 'replacement')} FROM c")
def rcp7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_compared(spark, d).select("layer", "replacement"))


@query("join12_mask_keys", f"WITH {_O} SELECT count(*) AS unmatched FROM (SELECT DISTINCT layer FROM o) a FULL JOIN (SELECT DISTINCT label AS layer FROM embeddings) b USING (layer) WHERE a.layer IS NULL OR b.layer IS NULL")
def join12(spark: SparkSession, d: str) -> DataFrame:
    a = order(spark, d).select("layer").distinct().withColumn("l", F.lit(1))
    b = load(spark, d, "embeddings").select(F.col("label").alias("layer")).distinct().withColumn("r", F.lit(1))
    return a.join(b, "layer", "full").filter("l is null or r is null").agg(F.count("*").alias("unmatched"))


@query("win14_rank_correlation", f"WITH {_CMP} SELECT layer, {_r('corr(o.rank, o2.rank)', 'rank_correlation')} FROM o JOIN o2 USING (layer, channel) GROUP BY layer")
def win14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.rank_correlation(order(spark, d), other_order(spark, d)))


_L = "l AS (SELECT vec_id AS sample, label AS pos, i::INTEGER AS token, embedding[i + 1]::DOUBLE * 10 AS teacher, embedding[64 - i]::DOUBLE * 8 AS probe FROM embeddings, range(64) r(i))"
_KL = f"{_L}, s AS (SELECT *, exp(teacher) / sum(exp(teacher)) OVER w AS p, exp(probe) / sum(exp(probe)) OVER w AS q, row_number() OVER (PARTITION BY sample, pos ORDER BY teacher DESC, token) AS r FROM l WINDOW w AS (PARTITION BY sample, pos)), z AS (SELECT sample, pos, greatest(p, 1e-12) AS p, greatest(q, 1e-12) AS q FROM s WHERE r <= 16 UNION ALL SELECT sample, pos, greatest(1 - sum(p), 1e-12), greatest(1 - sum(q), 1e-12) FROM s WHERE r <= 16 GROUP BY ALL), y AS (SELECT *, p / sum(p) OVER w AS pp, q / sum(q) OVER w AS qq FROM z WINDOW w AS (PARTITION BY sample, pos))"


def logits(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("pos"), "embedding", F.posexplode("embedding").alias("token", "x"))
    return e.select("sample", "pos", "token", (F.col("x").cast("double") * 10).alias("teacher"), (F.get("embedding", 63 - F.col("token")).cast("double") * 8).alias("probe"))


@query("num1_forward_kl", f"WITH {_KL} SELECT sample, pos, {_r('greatest(sum(pp * (ln(pp) - ln(qq))), 0)', 'kl')} FROM y GROUP BY ALL")
def num1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.forward_kl(logits(spark, d), 16))


@query("srt10_teacher_top_k", f"WITH {_L}, r AS (SELECT *, row_number() OVER (PARTITION BY sample, pos ORDER BY teacher DESC, token) AS r FROM l) SELECT sample, pos, array_to_string(list(token ORDER BY r), ',') AS tokens FROM r WHERE r <= 16 GROUP BY ALL")
def srt10(spark: SparkSession, d: str) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("teacher")).alias("t"), "token"))), 1, 16)
    return logits(spark, d).groupBy("sample", "pos").agg(F.array_join(F.transform(top, lambda x: x["token"]), ",").alias("tokens"))


_TOP = f"{_L}, r AS (SELECT *, row_number() OVER (PARTITION BY sample, pos ORDER BY teacher DESC, token) AS rt, row_number() OVER (PARTITION BY sample, pos ORDER BY probe DESC, token) AS rp FROM l)"


def top_sets(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("v"), "token"))), 1, 8), lambda x: x["token"])
    return logits(spark, d).groupBy("sample", "pos").agg(pick("teacher").alias("t"), pick("probe").alias("p"))


@query("set8_top_k_sets", f"WITH {_TOP} SELECT sample, pos, count(*) FILTER (rt <= 8 AND rp <= 8)::INTEGER AS shared, count(*) FILTER (rt <= 8 OR rp <= 8)::INTEGER AS either, count(*) FILTER (rt <= 8 AND rp > 8)::INTEGER AS only_teacher, count(*) FILTER (rp <= 8 AND rt > 8)::INTEGER AS only_student FROM r GROUP BY ALL")
def set8(spark: SparkSession, d: str) -> DataFrame:
    return top_sets(spark, d).select("sample", "pos", F.size(F.array_intersect("t", "p")).alias("shared"), F.size(F.array_union("t", "p")).alias("either"), F.size(F.array_except("t", "p")).alias("only_teacher"), F.size(F.array_except("p", "t")).alias("only_student"))


@query("agg38_overlap_ratio", f"WITH {_TOP}, x AS (SELECT sample, pos, count(*) FILTER (rt <= 8 AND rp <= 8) / 8 AS o FROM r GROUP BY ALL) SELECT pos, {_r('avg(o)', 'overlap')} FROM x GROUP BY pos")
def agg38(spark: SparkSession, d: str) -> DataFrame:
    return rounded(set8(spark, d).groupBy("pos").agg(F.avg(F.col("shared") / 8).alias("overlap")))


@query("num34_top_k_reward", f"WITH {_L}, s AS (SELECT *, ln(exp(teacher) / sum(exp(teacher)) OVER w) AS a, ln(exp(probe) / sum(exp(probe)) OVER w) AS b, row_number() OVER (PARTITION BY sample, pos ORDER BY teacher DESC, token) AS r FROM l WINDOW w AS (PARTITION BY sample, pos)), k AS (SELECT *, exp(b) / sum(exp(b)) OVER (PARTITION BY sample, pos) AS wt FROM s WHERE r <= 8) SELECT sample, pos, {_r('sum(-(b - a) * wt)', 'reward')} FROM k GROUP BY ALL")
def num34(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("sample", "pos")
    s = im.shifted(logits(spark, d), ["teacher", "probe"]).withColumn("a", F.col("teacher") - F.log(F.sum(F.exp("teacher")).over(w))).withColumn("b", F.col("probe") - F.log(F.sum(F.exp("probe")).over(w)))
    s = s.withColumn("r", F.row_number().over(w.orderBy(F.desc("teacher"), "token"))).filter("r <= 8")
    s = s.withColumn("wt", F.exp("b") / F.sum(F.exp("b")).over(w))
    return rounded(s.groupBy("sample", "pos").agg(F.sum(-(F.col("b") - F.col("a")) * F.col("wt")).alias("reward")))


@query("num36_entropy", f"WITH {_L}, s AS (SELECT *, exp(teacher) / sum(exp(teacher)) OVER (PARTITION BY sample, pos) AS p FROM l), t AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY sample, pos ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.9 AS nucleus, token = sample % 64 AS chosen FROM s) SELECT sample, pos, {_r('-sum(p * ln(p))', 'entropy')}, {_r('max(ln(p)) FILTER (chosen)', 'logprob')}, count(*) FILTER (nucleus) AS kept, bool_or(chosen AND nucleus) AS inside FROM t GROUP BY ALL")
def num36(spark: SparkSession, d: str) -> DataFrame:
    return rounded(im.token_statistics(logits(spark, d), F.col("sample") % 64, 0.9))


@query("rcp11_weighted_statistics", f"WITH {_KL}, kl AS (SELECT sample, pos, greatest(sum(pp * (ln(pp) - ln(qq))), 0) AS kl FROM y GROUP BY ALL), {_A}, j AS (SELECT layer, channel, sum(abs(x) * kl) / sum(kl) AS score FROM a JOIN kl USING (sample) GROUP BY layer, channel) SELECT layer, channel, {_r('score', 'score')} FROM j")
def rcp11(spark: SparkSession, d: str) -> DataFrame:
    """Importance with samples weighted by their divergence."""
    kl = im.forward_kl(logits(spark, d), 16).select("sample", "kl")
    j = acts(spark, d).join(kl, "sample")
    return rounded(j.groupBy("layer", "channel").agg((F.sum(F.abs("x") * F.col("kl")) / F.sum("kl")).alias("score")))


_PN = "(SELECT concat(CASE p_size % 4 WHEN 0 THEN 'layers.mlp.up.' WHEN 1 THEN 'layers.attn.q.' WHEN 2 THEN 'embed.' ELSE 'norm.' END, p_partkey) AS name, p_size AS size FROM part)"


@query("agg39_parameter_breakdown", f"SELECT CASE WHEN name LIKE '%mlp%' THEN 'ffn' WHEN name LIKE '%attn%' THEN 'attention' WHEN name LIKE '%embed%' THEN 'embedding' ELSE 'other' END AS kind, sum(size)::BIGINT AS n_parameters, {_r('sum(size) / sum(sum(size)) OVER ()', 'share')} FROM {_PN} GROUP BY kind")
def agg39(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 4
    name = F.concat(F.when(m == 0, "layers.mlp.up.").when(m == 1, "layers.attn.q.").when(m == 2, "embed.").otherwise("norm."), "p_partkey")
    return rounded(im.parameter_breakdown(load(spark, d, "part").select(name.alias("name"), F.col("p_size").alias("size"))))


@query("sca33_keep_size", "SELECT p_partkey, least(greatest(floor(p_size * 64 * 0.75 / 128 + 0.5) * 128, 128), p_size * 64)::INTEGER AS keep FROM part")
def sca33(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", im.keep_size(F.col("p_size") * 64, 0.25, 128).alias("keep"))


@query("sca34_target_ratio", f"SELECT p_partkey, {_r('0.25 * (p_size * 3 + 100) / (p_size * 3)', 'ffn_ratio')} FROM part WHERE 0.25 * (p_size * 3 + 100) < p_size * 3")
def sca34(spark: SparkSession, d: str) -> DataFrame:
    """The share of feed-forward weights to remove so that a quarter of all weights goes."""
    ffn = F.col("p_size") * 3
    return rounded(load(spark, d, "part").filter(0.25 * (ffn + 100) < ffn).select("p_partkey", (0.25 * (ffn + 100) / ffn).alias("ffn_ratio")))


@query("sca35_cost_model", "SELECT p_partkey, (3 * 4096 * p_size * 36)::BIGINT AS parameters, (2 * 3 * 4096 * p_size * 36)::BIGINT AS flops_per_token FROM part")
def sca35(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(3 * 4096 * 36).cast("bigint") * F.col("p_size")
    return load(spark, d, "part").select("p_partkey", n.alias("parameters"), (2 * n).alias("flops_per_token"))


@query("num7_kept_slice", f"WITH {_MASKS} SELECT a.layer, sample, a.channel, {_r('x', 'x')} FROM a JOIN k ON a.layer = k.layer AND a.channel = k.channel WHERE ratio = 0.35")
def num7(spark: SparkSession, d: str) -> DataFrame:
    kept = num6(spark, d).filter("ratio = 0.35").select("layer", "channel")
    return rounded(acts(spark, d).join(kept, ["layer", "channel"], "left_semi").select("layer", "sample", "channel", "x"))


@query("join8_translate_channels", f"WITH {_MASKS}, i AS (SELECT layer, channel, row_number() OVER (PARTITION BY layer ORDER BY channel) - 1 AS local FROM k WHERE ratio = 0.15) SELECT k.layer, k.channel, local FROM k JOIN i USING (layer, channel) WHERE k.ratio = 0.35")
def join8(spark: SparkSession, d: str) -> DataFrame:
    """Original channels as places in an already pruned layer; a channel that is gone fails."""
    from pyspark.sql.window import Window

    masks = num6(spark, d)
    local = masks.filter("ratio = 0.15").select("layer", "channel", (F.row_number().over(Window.partitionBy("layer").orderBy("channel")) - 1).alias("local"))
    j = masks.filter("ratio = 0.35").select("layer", "channel").join(local, ["layer", "channel"], "left")
    return j.withColumn("local", F.coalesce("local", F.raise_error(F.concat(F.lit("channel not kept: "), F.col("channel").cast("string"))).cast("int")))


@query("flt22_mask_matches", f"WITH {_MASKS}, x AS (SELECT layer, ratio, array_to_string(list_sort(list(channel)), ',') AS c FROM k GROUP BY ALL) SELECT a.layer, a.c = b.c AS same FROM x a JOIN x b USING (layer) WHERE a.ratio = 0.25 AND b.ratio = 0.25")
def flt22(spark: SparkSession, d: str) -> DataFrame:
    x = num6(spark, d).filter("ratio = 0.25").groupBy("layer").agg(F.array_sort(F.collect_list("channel")).alias("c"))
    y = im.nested_masks(order(spark, d), [0.25], 8).groupBy("layer").agg(F.array_sort(F.collect_list("channel")).alias("e"))
    return x.join(y, "layer", "full").select("layer", (F.col("c") == F.col("e")).alias("same"))


@query("str2_channel_accumulators", f"WITH {_A} SELECT layer, channel, count(*) AS n, {_r('sum(x)', 'total')}, {_r('sum(x * x)', 'squares')} FROM a GROUP BY ALL")
def str2(spark: SparkSession, d: str) -> DataFrame:
    """Accumulated over a stream of files (available now), and read from its sink."""
    from loomspark.streaming import accumulators

    return rounded(accumulators.accumulate_files(spark, d))
