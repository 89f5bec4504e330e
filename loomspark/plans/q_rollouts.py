"""Grouped, token and loss statistics: order lines stand for tokens, orders for responses, customers for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.operators import rollouts as ro
from loomspark.operators import sampling
from loomspark.plans.registry import query
from loomspark.session import load

_T = """t AS (SELECT l_orderkey AS seq, o_custkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity / 49 AS reward, l_discount * 5 AS value, l_tax * -20 AS old_lp, l_tax * -20 + (l_discount - 0.05) * 4 AS lp, l_extendedprice / -50000 AS ref_lp, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_S = f"{_T}, s AS (SELECT seq, uid, sum(reward) AS score, sum(mask) AS length FROM t GROUP BY ALL)"
_G = f"{_S}, g AS (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w > 1 THEN avg(score) OVER w ELSE 0 END AS m, CASE WHEN count(*) OVER w > 1 THEN stddev_samp(score) OVER w ELSE 1 END AS sd FROM s WINDOW w AS (PARTITION BY uid))"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    line, order = load(spark, d, "lineitem"), load(spark, d, "orders").select("o_orderkey", "o_custkey")
    t = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    tax, off = F.col("l_tax"), F.col("l_discount")
    return t.select(F.col("l_orderkey").alias("seq"), F.col("o_custkey").alias("uid"), pos.alias("pos"), (F.col("l_quantity") / 49).alias("reward"), (off * 5).alias("value"), (tax * -20).alias("old_lp"), (tax * -20 + (off - 0.05) * 4).alias("lp"), (F.col("l_extendedprice") / -50000).alias("ref_lp"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return ro.sequences(tokens(spark, d))


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str) -> str:
    return f"round({x}, 7) + 0.0 AS {name}"


def _r10(x: str, name: str) -> str:
    return f"round({x}, 10) + 0.0 AS {name}"


#: Advantages of sequences: name, operator, SQL of the advantage over the grouped sequences.
for _name, _f, _sql in [
    ("num11_grpo", lambda s: ro.grpo(s), f"WITH {_G} SELECT seq, uid, {_r('(score - m) / (sd + 1e-6)', 'advantage')} FROM g"),
    ("num11_grpo_centred", lambda s: ro.grpo(s, False), f"WITH {_G} SELECT seq, uid, {_r('score - m', 'advantage')} FROM g"),
    ("num13_grpo_vectorized", ro.grpo_vectorized, f"WITH {_S}, q AS (SELECT uid, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM s GROUP BY uid) SELECT seq, uid, {_r('(score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sqrt(greatest(v, 1e-6)) END + 1e-6)', 'advantage')} FROM s JOIN q USING (uid)"),
    ("num14_pass_at_k", ro.pass_at_k_advantage, f"WITH {_G}, k AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM g WINDOW w AS (PARTITION BY uid ORDER BY score DESC, seq)) SELECT seq, uid, {_r('CASE WHEN r = 1 THEN (score - second) / (sd + 1e-6) ELSE 0 END', 'advantage')} FROM k WHERE n >= 2"),
    ("num16_rloo", ro.rloo, f"WITH {_G} SELECT seq, uid, {_r('CASE WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE score END', 'advantage')} FROM g"),
    ("num17_rloo_vectorized", lambda s: ro.rloo(s, True), f"WITH {_G} SELECT seq, uid, {_r('CASE WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE 0 END', 'advantage')} FROM g"),
    ("num18_opo", ro.opo, f"WITH {_S}, q AS (SELECT uid, count(*) AS n, sum(length * score) / nullif(sum(length), 0) AS b FROM s GROUP BY uid) SELECT seq, uid, {_r('score - CASE WHEN n > 1 THEN b ELSE 0 END', 'advantage')} FROM s JOIN q USING (uid)"),
    ("num21_gpg", ro.gpg, f"WITH {_G}, a AS (SELECT count(*) / greatest(count(*) FILTER (score <> 0), 1) AS alpha FROM s) SELECT seq, uid, {_r('alpha * (score - m)', 'advantage')} FROM g, a"),
]:
    query(_name, _sql)(lambda spark, d, f=_f: rounded(f(seqs(spark, d))))

query("win15_group_relative", f"WITH {_G} SELECT seq, {_r('m', 'g_mean')}, {_r('sd', 'g_std')}, n AS g_n FROM g")(lambda spark, d: rounded(ro._group(seqs(spark, d)).select("seq", "g_mean", "g_std", "g_n")))
query("join11_group_back", f"WITH {_G} SELECT seq, {_r('score - m', 'centred')} FROM g")(lambda spark, d: rounded(ro._group(seqs(spark, d)).select("seq", (F.col("score") - F.col("g_mean")).alias("centred"))))
query("agg20_group_mean_std", f"WITH {_S} SELECT uid, {_r('CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END', 'mean')}, {_r('CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), 1e-6)) END', 'std')}, count(*) AS n FROM s GROUP BY uid")(lambda spark, d: rounded(ro.group_mean_std(seqs(spark, d))))

_VM = "CASE WHEN mask > 0 THEN {} END"
_WHITE = "({x} - sum({x} * mask) OVER () / (sum(mask) OVER () + 1e-8)) / sqrt(var_samp(CASE WHEN mask > 0 THEN {x} END) OVER () + 1e-8)"


@query("agg22_masked_statistics", f"WITH {_T} SELECT {_r('sum(value * mask)', 'total')}, {_r('sum(value * mask) / (sum(mask) + 1e-8)', 'mean')}, {_r('var_samp(CASE WHEN mask > 0 THEN value END)', 'variance')}, sum(mask)::BIGINT AS n FROM t")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.masked_statistics(tokens(spark, d), "value"))


@query("agg22_whiten", f"WITH {_T} SELECT seq, pos, {_r(_WHITE.format(x='value'), 'whitened')} FROM t")
def agg22w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.whiten(tokens(spark, d), "value", "whitened").select("seq", "pos", "whitened"))


@query("agg23_mean_max_min_std", f"WITH {_T} SELECT {_r('avg(reward)', 'mean')}, {_r('max(reward)', 'largest')}, {_r('min(reward)', 'least')}, {_r('stddev_samp(reward)', 'std')} FROM t")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens(spark, d).agg(F.avg("reward").alias("mean"), F.max("reward").alias("largest"), F.min("reward").alias("least"), F.stddev_samp("reward").alias("std")))


@query("agg24_masked_mean", f"WITH {_T} SELECT {_r('sum(reward * mask) / sum(mask)', 'mean')} FROM t")
def agg24(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens(spark, d).agg((F.sum(F.col("reward") * F.col("mask")) / F.sum("mask")).alias("mean")))


@query("num15_reinforce_pp_baseline", f"WITH {_G}, c AS (SELECT t.seq, pos, mask, score - m AS c FROM t JOIN g ON t.seq = g.seq) SELECT seq, pos, round({_WHITE.format(x='c')} * mask, 7) + 0.0 AS advantage FROM c")
def num15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.reinforce_pp_baseline(tokens(spark, d)))


_GAE = f"""WITH RECURSIVE {_T}, n AS (SELECT seq, max(pos) AS n FROM t GROUP BY seq), r(seq, pos, nxt, lst) AS (SELECT seq, n + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT r.seq, t.pos, CASE WHEN t.mask = 1 THEN t.value ELSE r.nxt END, CASE WHEN t.mask = 1 THEN t.reward + 0.99 * r.nxt - t.value + 0.99 * 0.95 * r.lst ELSE r.lst END FROM r JOIN t ON t.seq = r.seq AND t.pos = r.pos - 1), a AS (SELECT t.*, r.lst AS a FROM r JOIN t USING (seq, pos))"""


@query("num10_gae", f"{_GAE} SELECT seq, pos, {_r10(_WHITE.format(x='a'), 'advantage')}, {_r10('a + value', 'returns')} FROM a")
def num10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.gae(tokens(spark, d)), 10)


query("win8_gae_recursion", f"{_GAE} SELECT seq, pos, {_r10('a + value', 'returns')} FROM a")(lambda spark, d: num10(spark, d).select("seq", "pos", "returns"))

_DISC = f"""WITH RECURSIVE {_T}, n AS (SELECT seq, max(pos) AS n FROM t GROUP BY seq), r(seq, pos, run, a) AS (SELECT seq, n + 1, 0.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT r.seq, t.pos, (t.reward + 0.9 * r.run) * t.mask, t.reward + 0.9 * r.run FROM r JOIN t ON t.seq = r.seq AND t.pos = r.pos - 1), x AS (SELECT t.*, r.a FROM r JOIN t USING (seq, pos))"""


@query("num19_reinforce_pp", f"{_DISC} SELECT seq, pos, round({_WHITE.format(x='a')} * mask, 7) + 0.0 AS advantage, {_r('a', 'returns')} FROM x")
def num19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.reinforce_pp(tokens(spark, d)))


@query("win7_discounted_return", f"{_DISC} SELECT seq, pos, {_r('a', 'returns')} FROM x")
def win7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.discounted_returns(tokens(spark, d)).select("seq", "pos", F.col("a").alias("returns")))


@query("win9_reward_to_go", f"WITH {_T} SELECT seq, pos, {_r('sum(reward) OVER (PARTITION BY seq ORDER BY pos DESC)', 'to_go')} FROM t")
def win9(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    return rounded(t.select("seq", "pos", ro.reward_to_go(t, F.col("reward")).alias("to_go")))


@query("num20_remax", f"WITH {_T}, b AS (SELECT seq, avg(value) AS base FROM t GROUP BY seq), x AS (SELECT t.*, base, sum(reward * mask) OVER (PARTITION BY seq ORDER BY pos DESC) AS r FROM t JOIN b USING (seq)) SELECT seq, pos, {_r('r - base * mask', 'advantage')}, {_r('r', 'returns')} FROM x")
def num20(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    return rounded(ro.remax(t, t.groupBy("seq").agg(F.avg("value").alias("base"))))


@query("num12_process_grpo", f"WITH {_T}, v AS (SELECT uid, CASE WHEN count(*) > 1 THEN avg(reward) ELSE 0 END AS m, CASE WHEN count(*) > 1 THEN stddev_samp(reward) ELSE 1 END AS s FROM t WHERE mask = 1 GROUP BY uid), x AS (SELECT t.seq, pos, mask, CASE WHEN mask = 1 THEN (reward - m) / (s + 1e-6) ELSE 0 END AS x FROM t LEFT JOIN v USING (uid)) SELECT seq, pos, round(sum(x) OVER (PARTITION BY seq ORDER BY pos DESC) * mask, 6) + 0.0 AS advantage FROM x")
def num12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.process_grpo(tokens(spark, d)), 6)


@query("num22_direct_plus_grpo", f"WITH {_G} SELECT t.seq, pos, round((reward + 0.5 * (score - m) / (sd + 1e-6)) * mask, 7) + 0.0 AS advantage FROM t JOIN g ON t.seq = g.seq")
def num22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.direct_plus_grpo(tokens(spark, d), 0.5))


_D = "(lp - ref_lp)"


@query("num8_kl_estimators", f"WITH {_T} SELECT seq, pos, {_r(_D, 'k1')}, {_r(f'abs{_D}', 'abs')}, {_r(f'0.5 * {_D} * {_D}', 'k2')}, {_r(f'least(greatest(exp(least(greatest(-{_D}, -20), 20)) - least(greatest(-{_D}, -20), 20) - 1, -10), 10)', 'k3')} FROM t")
def num8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens(spark, d).select("seq", "pos", *[ro.kl_estimate(F.col("lp"), F.col("ref_lp"), k).alias(k) for k in ("k1", "abs", "k2", "k3")]))


@query("num9_kl_penalised_reward", f"WITH {_T} SELECT seq, {_r(f'sum(reward - 0.1 * {_D} * mask)', 'reward')}, {_r(f'sum({_D} * mask) / (sum(mask) + 1e-8)', 'kl')} FROM t GROUP BY seq")
def num9(spark: SparkSession, d: str) -> DataFrame:
    kl, m = ro.kl_estimate(F.col("lp"), F.col("ref_lp"), "k1"), F.col("mask")
    return rounded(tokens(spark, d).groupBy("seq").agg(F.sum(F.col("reward") - 0.1 * kl * m).alias("reward"), ro.masked_mean(kl, m).alias("kl")))


_ADV = "(reward - 0.5)"
_DD = "(lp - old_lp)"


def adv():  # noqa: ANN201
    return F.col("reward") - 0.5


@query("agg33_loss_modes", f"WITH {_T}, p AS (SELECT seq, sum({_ADV} * lp * mask) AS s, sum(mask) AS n FROM t GROUP BY seq) SELECT {_r('sum(s) / (sum(n) + 1e-8)', 'token_mean')}, {_r('sum(s) FILTER (n > 0) / (count(*) FILTER (n > 0) + 1e-8)', 'seq_mean_token_sum')}, {_r('sum(s / (n + 1e-8)) FILTER (n > 0) / (count(*) FILTER (n > 0) + 1e-8)', 'seq_mean_token_mean')}, {_r('sum(s) / 16', 'seq_mean_token_sum_norm')} FROM p")
def agg33(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.aggregate_loss(tokens(spark, d), adv() * F.col("lp"), F.col("mask"), 16))


_PPO = f"x AS (SELECT *, -{_ADV} * exp({_DD}) AS a1, -{_ADV} * least(greatest(exp({_DD}), 0.8), 1.2) AS a2, -{_ADV} * 3.0 AS a3 FROM t)"


@query("num23_ppo_loss", f"WITH {_T}, {_PPO} SELECT {_r(f'sum(CASE WHEN {_ADV} < 0 THEN least(a3, greatest(a1, a2)) ELSE greatest(a1, a2) END * mask) / (sum(mask) + 1e-8)', 'pg_loss')}, {_r('sum((a2 > a1)::INT * mask) / (sum(mask) + 1e-8)', 'clip_fraction')}, {_r(f'sum((greatest(a1, a2) > a3 AND {_ADV} < 0)::INT * mask) / (sum(mask) + 1e-8)', 'clip_fraction_lower')}, {_r(f'sum(-{_DD} * mask) / (sum(mask) + 1e-8)', 'approx_kl')} FROM x")
def num23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.ppo_loss(tokens(spark, d), adv()))


@query("num24_gspo_loss", f"WITH {_T}, r AS (SELECT seq, exp(least(sum({_DD} * mask) / greatest(sum(mask), 1), 10)) AS r FROM t GROUP BY seq), p AS (SELECT seq, sum(greatest(-{_ADV} * r, -{_ADV} * least(greatest(r, 0.8), 1.2)) * mask) AS s, sum(mask) AS n FROM t JOIN r USING (seq) GROUP BY seq) SELECT {_r('sum(s / (n + 1e-8)) FILTER (n > 0) / (count(*) FILTER (n > 0) + 1e-8)', 'pg_loss')} FROM p")
def num24(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.gspo_loss(tokens(spark, d), adv()))


@query("num25_gpg_loss", f"WITH {_T} SELECT {_r(f'sum(-lp * {_ADV} * mask) / (sum(mask) + 1e-8)', 'pg_loss')} FROM t")
def num25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens(spark, d).agg(ro.masked_mean(-F.col("lp") * adv(), F.col("mask")).alias("pg_loss")))


_COV = f"mm AS (SELECT sum({_ADV} * mask) / (sum(mask) + 1e-8) AS ma, sum(lp * mask) / (sum(mask) + 1e-8) AS ml, sum(mask) AS valid FROM t), c AS (SELECT t.*, valid, ({_ADV} - ma) * (lp - ml) AS cov FROM t, mm)"


@query("num26_clip_cov_loss", f"WITH {_T}, {_COV}, x AS (SELECT *, -{_ADV} * exp({_DD}) AS a1, -{_ADV} * least(greatest(exp({_DD}), 0.8), 1.2) AS a2 FROM c), i AS (SELECT *, mask > 0 AND NOT a2 > a1 AND cov > 0.05 AND cov < 0.3 AS inside FROM x), k AS (SELECT *, inside AND row_number() OVER (PARTITION BY inside ORDER BY sha256(concat_ws(':', 'cc', seq, pos)), seq, pos) <= greatest(floor(valid * 0.01), 1) AS gone FROM i) SELECT {_r('sum(greatest(a1, a2) * (1 - gone::INT) * mask) / (sum(mask) + 1e-8)', 'pg_loss')}, {_r('sum(gone::INT * mask) / (sum(mask) + 1e-8)', 'clip_fraction')} FROM k")
def num26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.clip_cov_loss(tokens(spark, d), adv(), 0.01, 0.05, 0.3, "cc"))


@query("num27_kl_cov_loss", f"WITH {_T}, {_COV}, k AS (SELECT *, mask = 1 AND row_number() OVER (PARTITION BY mask ORDER BY round(cov, 12) DESC, seq, pos) <= greatest(1, floor(valid * 0.02)) AS top FROM c) SELECT round(sum((-{_ADV} * exp({_DD}) + CASE WHEN top THEN abs({_DD}) ELSE 0 END) * mask) / (sum(mask) + 1e-8), 5) AS pg_loss, {_r(f'sum(abs({_DD}) * mask) / (sum(mask) + 1e-8)', 'abs_kl')} FROM k")
def num27(spark: SparkSession, d: str) -> DataFrame:
    return ro.kl_cov_loss(tokens(spark, d), adv(), 0.02).select(F.round("pg_loss", 5).alias("pg_loss"), F.round("abs_kl", 7).alias("abs_kl"))


@query("num28_geo_mean_loss", f"WITH {_T}, x AS (SELECT *, sign({_ADV}) * least(sign({_ADV}) * {_DD}, sign({_ADV}) * least(greatest({_DD}, -0.2), 0.2)) AS d FROM t), p AS (SELECT sum(d * mask) AS d, sum({_ADV} * mask) AS a, sum(mask) + 1e-8 AS n FROM x GROUP BY seq) SELECT {_r('avg(-(a / n) * exp(d / n))', 'pg_loss')} FROM p")
def num28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.geo_mean_loss(tokens(spark, d), adv()))


@query("num29_value_loss", f"WITH {_T}, x AS (SELECT *, pow(lp - reward, 2) AS a, pow(greatest(least(lp, value + 0.2), value - 0.2) - reward, 2) AS b FROM t) SELECT {_r('0.5 * sum(greatest(a, b) * mask) / (sum(mask) + 1e-8)', 'vf_loss')}, {_r('sum((b > a)::INT * mask) / (sum(mask) + 1e-8)', 'vf_clip_fraction')} FROM x")
def num29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.value_loss(tokens(spark, d), F.col("lp"), F.col("reward"), 0.2))


@query("num30_importance_weights", f"WITH {_T}, s AS (SELECT seq, sum({_DD} * mask) AS d FROM t GROUP BY seq) SELECT t.seq, pos, {_r(f'least(exp(least(greatest({_DD}, -20), 20)) * mask, 1.15)', 'token_weight')}, {_r('least(exp(least(greatest(d, -20), 20)) * mask, 1.15)', 'sequence_weight')} FROM t JOIN s USING (seq)")
def num30(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    a = ro.importance_weights(t, "token", 1.15).withColumnRenamed("weight", "token_weight")
    return rounded(a.join(ro.importance_weights(t, "sequence", 1.15).withColumnRenamed("weight", "sequence_weight"), ["seq", "pos"]))


_IN = "(mask * (exp({0}) >= 1 / 1.13 AND exp({0}) <= 1.13)::INT)"


@query("num31_rejection_mask", f"WITH {_T}, s AS (SELECT seq, sum({_DD} * mask) AS ds, sum({_DD} * mask) / (sum(mask) + 1e-8) AS dm FROM t GROUP BY seq) SELECT t.seq, pos, {_IN.format('ds')} AS by_sequence, {_IN.format('dm')} AS by_geometric FROM t JOIN s USING (seq)")
def num31(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    a = ro.rejection_mask(t, "sequence", 1.13).withColumnRenamed("kept", "by_sequence")
    return a.join(ro.rejection_mask(t, "geometric", 1.13).withColumnRenamed("kept", "by_geometric"), ["seq", "pos"])


@query("num32_veto", f"WITH {_T} SELECT seq, bool_or({_DD} < ln(0.85) AND mask = 1) AS vetoed FROM t GROUP BY seq")
def num32(spark: SparkSession, d: str) -> DataFrame:
    return ro.veto(tokens(spark, d), 0.85)


@query("num33_corrected_loss", f"WITH {_T}, {_PPO} SELECT {_r('sum(greatest(a1, a2) * least(exp(lp - old_lp), 1.15) * mask) / (sum(mask) + 1e-8)', 'pg_loss')} FROM x")
def num33(spark: SparkSession, d: str) -> DataFrame:
    """The clipped loss under truncated token weights."""
    d_ = F.col("lp") - F.col("old_lp")
    ratio = F.exp(d_)
    loss = F.greatest(-adv() * ratio, -adv() * ro.clamp(ratio, 0.8, 1.2))
    return rounded(tokens(spark, d).agg(ro.masked_mean(loss * F.least(ratio, F.lit(1.15)), F.col("mask")).alias("pg_loss")))


@query("agg36_effective_sample_size", f"WITH {_T}, w AS (SELECT exp({_DD}) AS w FROM t WHERE mask = 1) SELECT {_r('pow(avg(w), 2) / avg(w * w)', 'ess')}, {_r('avg(w)', 'mean')}, {_r('min(w)', 'least')}, {_r('max(w)', 'largest')} FROM w")
def agg36(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.effective_sample_size(tokens(spark, d)))


@query("agg37_off_policy", f"WITH {_T}, p AS (SELECT sum(lp * mask) / (sum(mask) + 1e-8) AS a, sum(old_lp * mask) / (sum(mask) + 1e-8) AS b FROM t GROUP BY seq), q AS (SELECT avg(exp(-a)) AS ppl_new, avg(exp(-b)) AS ppl_old, avg(b - a) AS log_ppl_diff, avg(exp(b - a)) AS ppl_ratio FROM p), r AS (SELECT sum(-{_DD} * mask) / (sum(mask) + 1e-8) AS kl, sum((exp({_DD}) - {_DD} - 1) * mask) / (sum(mask) + 1e-8) AS k3, sum(exp(2 * {_DD}) * mask) / (sum(mask) + 1e-8) - 1 AS chi2 FROM t) SELECT {', '.join(_r(c, c) for c in ('ppl_new', 'ppl_old', 'log_ppl_diff', 'ppl_ratio', 'kl', 'k3', 'chi2'))} FROM q, r")
def agg37(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.off_policy_metrics(tokens(spark, d)))


@query("agg25_data_metrics", f"WITH {_S} SELECT count(*) AS n, {_r('avg(score)', 'score_mean')}, {_r('max(score)', 'score_max')}, {_r('min(score)', 'score_min')}, {_r('stddev_samp(score)', 'score_std')}, {_r('avg(abs(score))', 'score_abs_mean')}, count(*) FILTER (round(abs(score), 9) > 5) AS extreme, {_r('avg(length)', 'length_mean')}, max(length)::BIGINT AS length_max, min(length)::BIGINT AS length_min, {_r('avg((length = 0)::INT)', 'aborted_ratio')} FROM s")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.data_metrics(tokens(spark, d)))


@query("agg25_explained_variance", f"WITH {_T} SELECT {_r('1 - var_samp(reward - value) / (var_samp(reward) + 1e-5)', 'explained_variance')} FROM t WHERE mask = 1")
def agg25v(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.explained_variance(tokens(spark, d), F.col("reward")))


@query("agg26_prefix_means", f"WITH {_T} SELECT c::INTEGER AS cutoff, {_r('avg(reward)', 'mean_reward')} FROM t, (VALUES (1), (2), (4), (8)) v(c) WHERE pos <= c AND mask = 1 GROUP BY c")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.prefix_means(tokens(spark, d), [1, 2, 4, 8]))


@query("flt24_aborted", f"WITH {_S} SELECT seq FROM s WHERE length = 0")
def flt24(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).filter("length = 0").select("seq")


@query("win10_response_mask", f"WITH {_T} SELECT seq, pos, (coalesce(sum((reward > 0.9)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)::INT AS live FROM t")
def win10(spark: SparkSession, d: str) -> DataFrame:
    return ro.response_mask(tokens(spark, d), F.col("reward") > 0.9)


_DIV = f"x AS (SELECT seq, pos, mask, coalesce(lag(abs(lp - ref_lp)) OVER (PARTITION BY seq ORDER BY pos), 0) * mask AS d FROM t)"


@query("win11_shifted_divergence", f"WITH {_T}, {_DIV} SELECT seq, pos, {_r('d', 'shifted')} FROM x")
def win11(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    shifted = F.coalesce(F.lag(F.abs(F.col("lp") - F.col("ref_lp"))).over(Window.partitionBy("seq").orderBy("pos")), F.lit(0.0)) * F.col("mask")
    return rounded(t.select("seq", "pos", shifted.alias("shifted")))


@query("win12_trajectory_weights", f"WITH {_T}, {_DIV}, y AS (SELECT *, sum(d) OVER (PARTITION BY seq) AS s, sum(mask) OVER (PARTITION BY seq) AS n FROM x) SELECT seq, pos, {_r('CASE WHEN s > 1e-9 THEN d / s WHEN n > 0 THEN mask / n ELSE 0 END', 'weight')} FROM y")
def win12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ro.trajectory_weights(tokens(spark, d), F.abs(F.col("lp") - F.col("ref_lp"))))


@query("srt11_top_two", f"WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, seq) AS r FROM s) SELECT uid, {_r('max(score) FILTER (r = 1)', 'best')}, {_r('max(score) FILTER (r = 2)', 'second')} FROM k GROUP BY uid")
def srt11(spark: SparkSession, d: str) -> DataFrame:
    k = seqs(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "seq"))).filter("r <= 2")
    return rounded(k.groupBy("uid").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second")))


@query("srt12_reweight", f"WITH {_S} SELECT seq, {_r('greatest(pow(abs(score), 2) + 1e-8, 1e-8)', 'pow_weight')}, {_r('(CASE WHEN score = max(score) OVER () OR score = min(score) OVER () THEN 1.0 ELSE 0.0 END) + 1e-8', 'max_min_weight')}, {_r('CASE WHEN score = max(score) OVER () THEN 0.4 ELSE 0.1 END + 1e-8', 'max_random_weight')} FROM s")
def srt12(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d)
    edge = s.agg(F.max("score").alias("hi"), F.min("score").alias("lo"))
    x = F.col("score")
    w = s.crossJoin(F.broadcast(edge)).select("seq", F.greatest(F.pow(F.abs(x), 2) + 1e-8, F.lit(1e-8)).alias("pow_weight"), (F.when((x == F.col("hi")) | (x == F.col("lo")), 1.0).otherwise(0.0) + 1e-8).alias("max_min_weight"), (F.when(x == F.col("hi"), 0.4).otherwise(0.1) + 1e-8).alias("max_random_weight"))
    return rounded(w)


_WEIGHTS = f"WITH {_S}, w AS (SELECT seq, (round(pow(abs(score), 2), 3) * 1000)::BIGINT + 1 AS w FROM s), c AS (SELECT seq, w, sum(w) OVER (ORDER BY seq) AS upto FROM w), tot AS (SELECT sum(w) AS total, count(*) AS n FROM w)"


@query("srt12_resample", f"{_WEIGHTS}, k AS (SELECT i AS draw, CAST('0x' || substr(sha256(concat('pf:', i)), 1, 15) AS BIGINT) % total AS u FROM tot, range(n) r(i)) SELECT draw, seq FROM k ASOF JOIN (SELECT seq, upto - w AS low FROM c) x ON k.u >= x.low")
def srt12_resample(spark: SparkSession, d: str) -> DataFrame:
    """As many sequences as there are, drawn with replacement by the squares of their scores."""
    s = seqs(spark, d).select("seq", "score")
    return sampling.weighted_draws(s, "seq", (F.round(F.pow(F.abs("score"), 2), 3) * 1000).cast("bigint") + 1, s.count(), "pf")


@query("srt16_workload", f"WITH {_S} SELECT seq, (24576 * length + length * length)::BIGINT AS workload FROM s")
def srt16(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).select("seq", (24576 * F.col("length") + F.col("length") * F.col("length")).alias("workload"))


_LOADS = f"WITH {_S}, z AS (SELECT length, (row_number() OVER (ORDER BY length DESC, seq) - 1) AS r, seq FROM s), p AS (SELECT 'before' AS side, seq % 8 AS part, sum(length) AS load FROM s GROUP BY part UNION ALL SELECT 'after', CASE WHEN (r // 8) % 2 = 0 THEN r % 8 ELSE 7 - r % 8 END AS part, sum(length) FROM z GROUP BY part)"


@query("agg34_length_imbalance", f"{_LOADS} SELECT side, min(load)::BIGINT AS least, max(load)::BIGINT AS largest, {_r('avg(load)', 'mean')}, {_r('(max(load) - min(load))::DOUBLE', 'spread')} FROM p GROUP BY side")
def agg34(spark: SparkSession, d: str) -> DataFrame:
    """Token loads of eight ranks, as the sequences come and when they are dealt out by length, forth and back."""
    s = seqs(spark, d).select("seq", "length")
    placed = sampling.global_rank(s.withColumn("k", -F.col("length")), ["k", "seq"], "r")
    dealt = F.when(F.floor(F.col("r") / 8) % 2 == 0, F.col("r") % 8).otherwise(7 - F.col("r") % 8)
    both = s.select(F.lit("before").alias("side"), F.pmod("seq", F.lit(8)).cast("bigint").alias("part"), "length").unionByName(placed.select(F.lit("after").alias("side"), dealt.cast("bigint").alias("part"), "length"))
    p = both.groupBy("side", "part").agg(F.sum("length").alias("load"))
    return rounded(p.groupBy("side").agg(F.min("load").alias("least"), F.max("load").alias("largest"), F.avg("load").alias("mean"), (F.max("load") - F.min("load")).alias("spread")))


@query("agg35_median_tokens", f"WITH {_S} SELECT uid, trunc(median(length))::BIGINT AS median_length FROM s GROUP BY uid")
def agg35(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).groupBy("uid").agg(F.median("length").cast("bigint").alias("median_length"))


@query("agg30_majority_value", "WITH c AS (SELECT o_custkey AS uid, o_orderpriority AS vote, count(*) AS n, min(o_orderkey) AS f, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL) SELECT uid, vote, value FROM c QUALIFY row_number() OVER (PARTITION BY uid ORDER BY n DESC, f) = 1")
def agg30(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("vote"), "o_totalprice", "o_orderkey")
    return ro.majority_value(o, "uid", "vote", "o_totalprice", "o_orderkey")


@query("agg31_validation_metrics", "WITH u AS (SELECT o_orderstatus AS source, o_custkey AS uid, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, count(*) AS n FROM orders GROUP BY ALL) SELECT source, round(avg(mean), 5) AS mean_at_n, round(avg(std), 5) AS std_at_n, max(n) AS n FROM u GROUP BY source")
def agg31(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("source"), "o_custkey").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"), F.count("*").alias("n"))
    return u.groupBy("source").agg(F.round(F.avg("mean"), 5).alias("mean_at_n"), F.round(F.avg("std"), 5).alias("std_at_n"), F.max("n").alias("n"))


@query("agg32_source_means", f"WITH {_S} SELECT o_orderpriority AS source, {_r('avg(score)', 'mean_score')} FROM s JOIN orders ON seq = o_orderkey GROUP BY source")
def agg32(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("source"))
    return rounded(seqs(spark, d).join(o, "seq").groupBy("source").agg(F.avg("score").alias("mean_score")))


@query("res1_agent_timing", f"WITH {_S} SELECT {_r('min(score)', 'least')}, {_r('max(score)', 'largest')}, {_r('avg(score)', 'mean')}, (SELECT seq FROM s ORDER BY score + length DESC, seq LIMIT 1) AS slowest FROM s")
def res1(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d)
    return rounded(s.agg(F.min("score").alias("least"), F.max("score").alias("largest"), F.avg("score").alias("mean"), F.max_by("seq", F.struct(F.col("score") + F.col("length"), -F.col("seq"))).alias("slowest")))


@query("res2_flops", f"WITH {_S} SELECT {_r('(6 * 8e9 * sum(length) + 12 * sum(length * length) * 128 * 32 * 36) / 1e12', 'tera_flops')} FROM s")
def res2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("length")
    return rounded(seqs(spark, d).agg(((6 * F.lit(8e9) * F.sum(n) + 12 * F.sum(n * n) * (128 * 32 * 36)) / 1e12).alias("tera_flops")))


@query("num35_kl_controller", f"WITH RECURSIVE {_T}, k AS (SELECT uid, seq, sum({_DD} * {_DD} * mask) / (sum(mask) + 1e-8) AS kl, row_number() OVER (PARTITION BY uid ORDER BY seq) AS i, count(*) OVER (PARTITION BY uid) AS n FROM t GROUP BY uid, seq), r(uid, i, c) AS (SELECT DISTINCT uid, 0::BIGINT, 0.2::DOUBLE FROM k UNION ALL SELECT r.uid, k.i, r.c * (1 + least(greatest(k.kl / 0.02 - 1, -0.2), 0.2) * 64 / 10000) FROM r JOIN k ON k.uid = r.uid AND k.i = r.i + 1) SELECT r.uid, {_r('c', 'coefficient')} FROM r JOIN (SELECT uid, max(n) AS n FROM k GROUP BY uid) m ON m.uid = r.uid AND m.n = r.i")
def num35(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("lp") - F.col("old_lp")
    k = tokens(spark, d).groupBy("uid", "seq").agg(ro.masked_mean(x * x, F.col("mask")).alias("kl"))
    k = k.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seq", "kl"))).alias("a"))
    return rounded(k.select("uid", ro.kl_controller(F.col("a.kl"), 0.2, 0.02, 10_000, 64).alias("coefficient")))


#: Seconds of a training step's sections come from the events: a step is a day, a section a kind of event.
_TIMES = "SELECT CAST(ts AS DATE) AS step, event_type AS section, sum(value) AS seconds, count(*) * 16 AS tokens FROM events GROUP BY ALL"


def timings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("step"), F.col("event_type").alias("section")).agg(F.sum("value").alias("seconds"), (F.count("*") * 16).alias("tokens"))


@query("agg27_timing_per_token", f"SELECT step::VARCHAR AS step, section, {_r('seconds', 'seconds')}, {_r('seconds * 1000 / tokens', 'ms_per_token')} FROM ({_TIMES})")
def agg27(spark: SparkSession, d: str) -> DataFrame:
    """Time of each section of a step, and per token."""
    return rounded(timings(spark, d).select(F.col("step").cast("string").alias("step"), "section", "seconds", (F.col("seconds") * 1000 / F.col("tokens")).alias("ms_per_token")))


@query("agg28_throughput", f"WITH t AS ({_TIMES}) SELECT step::VARCHAR AS step, sum(tokens)::BIGINT AS tokens, {_r('sum(seconds)', 'seconds')}, {_r('sum(tokens) / (sum(seconds) * 8)', 'throughput')} FROM t GROUP BY step")
def agg28(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per second and device of each step."""
    g = timings(spark, d).groupBy(F.col("step").cast("string").alias("step")).agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return rounded(g.select("step", "tokens", "seconds", (F.col("tokens") / (F.col("seconds") * 8)).alias("throughput")))


@query("res5_advantage_dispatch", f"WITH {_G} SELECT seq, {_r('CASE WHEN uid % 2 = 0 THEN (score - m) / (sd + 1e-6) WHEN n > 1 THEN n / (n - 1) * (score - m) ELSE score END', 'advantage')} FROM g")
def res5(spark: SparkSession, d: str) -> DataFrame:
    """Estimators chosen by name from a registry."""
    s = seqs(spark, d)
    picked = [ESTIMATORS[name](s.filter(F.col("uid") % 2 == k)) for k, name in enumerate(("grpo", "rloo"))]
    return rounded(picked[0].unionByName(picked[1]).select("seq", "advantage"))


ESTIMATORS = {"grpo": ro.grpo, "rloo": ro.rloo, "opo": ro.opo, "gpg": ro.gpg, "grpo_vectorized": ro.grpo_vectorized, "pass_at_k": ro.pass_at_k_advantage}
