"""Statistics of rollouts: advantages, returns, losses and corrections, over a long table of tokens.

Input: one row per token with `seq`, `uid` (the prompt's group), `pos` (1, 2, ...), `reward`, `value`, `old_lp`, `lp`,
`ref_lp` and `mask` (0 or 1). Sequence scores are sums of all token rewards. Whole-table statistics are one aggregate,
joined back as a single row; per-sequence order uses windows or folds within a sequence, never across.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspark.operators import sampling
from loomspark.session import checkpoint

EPS = 1e-6
SAFE = 20.0


def _alone(one: DataFrame, df: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(one))


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def sequences(tokens: DataFrame) -> DataFrame:
    """(seq, uid, score, length): summed rewards and counted valid tokens."""
    return tokens.groupBy("seq", "uid").agg(F.sum("reward").alias("score"), F.sum("mask").alias("length"))


def masked_mean(value: Column, mask: Column, floor: float = 1e-8) -> Column:
    return F.sum(value * mask) / (F.sum(mask) + floor)


def masked_statistics(tokens: DataFrame, value: str) -> DataFrame:
    """(total, mean, variance): sum, mean and unbiased variance over valid tokens."""
    v, m = F.col(value), F.col("mask")
    n, mean = F.sum("mask"), masked_mean(v, m)
    return tokens.agg(F.sum(v * m).alias("total"), mean.alias("mean"), F.var_samp(F.when(m > 0, v)).alias("variance"), n.alias("n"))


def whiten(tokens: DataFrame, value: str, out: str) -> DataFrame:
    """Values less their mean, over the root of their variance, both over valid tokens."""
    s = masked_statistics(tokens, value).select(F.col("mean").alias("_mean"), F.col("variance").alias("_var"))
    return _alone(s, tokens).withColumn(out, (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_mean", "_var")


def _group(seqs: DataFrame) -> DataFrame:
    """Sequences with their group's size, mean and sample deviation; alone: mean 0, deviation 1.

    Aggregated and joined back rather than windowed: the aggregate combines before the shuffle, so one prompt may own a
    third of all sequences.
    """
    g = seqs.groupBy("uid").agg(F.count("*").alias("g_n"), F.avg("score").alias("g_avg"), F.stddev_samp("score").alias("g_dev"))
    g = g.select("uid", "g_n", F.when(F.col("g_n") > 1, F.col("g_avg")).otherwise(0.0).alias("g_mean"), F.when(F.col("g_n") > 1, F.col("g_dev")).otherwise(1.0).alias("g_std"))
    return seqs.join(g, "uid")


def grpo(seqs: DataFrame, by_std: bool = True) -> DataFrame:
    g = _group(seqs)
    centred = F.col("score") - F.col("g_mean")
    return g.select("seq", "uid", (centred / (F.col("g_std") + EPS) if by_std else centred).alias("advantage"))


def group_mean_std(seqs: DataFrame, eps: float = EPS) -> DataFrame:
    """(uid, mean, std, n): unbiased variance with a floor; alone: mean 0, std 1."""
    g = seqs.groupBy("uid").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"))
    one = F.col("n") == 1
    return g.select("uid", F.when(one, 0.0).otherwise(F.col("m")).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest("v", F.lit(eps)))).alias("std"), "n")


def grpo_vectorized(seqs: DataFrame) -> DataFrame:
    return seqs.join(group_mean_std(seqs), "uid").select("seq", "uid", ((F.col("score") - F.col("mean")) / (F.col("std") + EPS)).alias("advantage"))


def pass_at_k_advantage(seqs: DataFrame) -> DataFrame:
    """The best sequence of a group gets its lead over the second, by the group's deviation; the others get 0."""
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "seq")
    top = seqs.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    best = top.groupBy("uid").agg(F.max(F.when(F.col("r") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("r") == 1, F.col("seq"))).alias("best"))
    g = _group(seqs).filter("g_n >= 2").join(best, "uid")
    lead = (F.col("first") - F.col("second")) / (F.col("g_std") + EPS)
    return g.select("seq", "uid", F.when(F.col("seq") == F.col("best"), lead).otherwise(0.0).alias("advantage"))


def rloo(seqs: DataFrame, vectorized: bool = False) -> DataFrame:
    """Score against the mean of the others; alone: the score itself, or 0 in the vectorized form."""
    g = _group(seqs)
    n = F.col("g_n")
    others = n / (n - 1) * (F.col("score") - F.col("g_mean"))
    return g.select("seq", "uid", F.when(n > 1, others).otherwise(F.lit(0.0) if vectorized else F.col("score")).alias("advantage"))


def opo(seqs: DataFrame) -> DataFrame:
    """Score less the group's mean weighted by length; alone: the score."""
    g = seqs.groupBy("uid").agg(F.count("*").alias("n"), (F.sum(F.col("length") * F.col("score")) / F.nullif(F.sum("length"), F.lit(0))).alias("base"))
    return seqs.join(g, "uid").select("seq", "uid", (F.col("score") - F.when(F.col("n") > 1, F.col("base")).otherwise(0.0)).alias("advantage"))


def gpg(seqs: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Centred scores times rows over rows with a score."""
    alpha = seqs.agg((F.count("*") / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("alpha"))
    return _alone(alpha, _group(seqs)).select("seq", "uid", (F.col("alpha") * (F.col("score") - F.col("g_mean")) / f_norm).alias("advantage"))


def reinforce_pp_baseline(tokens: DataFrame) -> DataFrame:
    """Scores centred by group, spread over tokens, whitened over all valid tokens."""
    s = _group(sequences(tokens)).select("seq", (F.col("score") - F.col("g_mean")).alias("c"))
    w = whiten(tokens.join(s, "seq"), "c", "a")
    return w.select("seq", "pos", (F.col("a") * F.col("mask")).alias("advantage"))


#: Cells of one padded block of sequences.
BLOCK_CELLS = 2_000_000


def fold_back(tokens: DataFrame, fields: list[str], step: Callable[[tuple, tuple], tuple[tuple, np.ndarray]], states: int) -> DataFrame:
    """(seq, pos, a): a recursion over each sequence from its last token to its first.

    The sequences of an Arrow batch run side by side, as columns of padded blocks; `step` takes the states and the fields
    of one position (vectors over sequences) and gives the new states and the position's result. Linear in the tokens,
    where a fold that appends to an array would be quadratic in a sequence.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rows: pd.Series, *columns: pd.Series) -> pd.Series:
        sizes = rows.to_numpy()
        out: list = [None] * len(sizes)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            width = max(1, int(sizes[order[at]]))
            part = order[at : at + max(1, BLOCK_CELLS // width)]
            at += len(part)
            blocks = []
            for c in columns:
                block = np.zeros((width, len(part)))
                for k, i in enumerate(part):
                    block[width - sizes[i] :, k] = c.iloc[i]
                blocks.append(block)
            live = width - sizes[part]
            state, result = tuple(np.zeros(len(part)) for _ in range(states)), np.zeros((width, len(part)))
            for t in range(width - 1, -1, -1):
                new, value = step(state, tuple(x[t] for x in blocks))
                here = t >= live
                state = tuple(np.where(here, n, o) for n, o in zip(new, state))
                result[t] = value
            for k, i in enumerate(part):
                out[i] = result[live[k] :, k]
        return pd.Series(out)

    g = tokens.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), *[F.col(f).cast("double").alias(f) for f in fields]))).alias("rows"))
    done = g.select("seq", *[F.col(f"rows.{f}").alias(f) for f in ("pos", *fields)], run(F.size("rows"), *[F.col(f"rows.{f}") for f in fields]).alias("a"))
    return done.select("seq", F.explode_outer(F.arrays_zip("pos", *fields, "a")).alias("x")).filter("x is not null").select("seq", "x.*")


def gae(tokens: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """(seq, pos, advantage, returns): backward recursion that skips masked positions; advantages whitened."""

    def step(state: tuple, now: tuple) -> tuple[tuple, np.ndarray]:
        (after, last), (reward, value, mask) = state, now
        new = reward + gamma * after - value + gamma * lam * last
        last = np.where(mask == 1, new, last)
        return (np.where(mask == 1, value, after), last), last

    # Value and mask come with the result: the tokens are read once, and whitening starts from what is written.
    folded = checkpoint(fold_back(tokens, ["reward", "value", "mask"], step, 2))
    return whiten(folded, "a", "w").select("seq", "pos", F.col("w").alias("advantage"), (F.col("a") + F.col("value")).alias("returns"))


def discounted_returns(tokens: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(seq, pos, a): discounted sums from behind; a masked position starts anew."""

    def step(state: tuple, now: tuple) -> tuple[tuple, np.ndarray]:
        (run,), (reward, mask) = state, now
        total = reward + gamma * run
        return (total * mask,), total

    return fold_back(tokens, ["reward", "mask"], step, 1).select("seq", "pos", "mask", "a")


def reinforce_pp(tokens: DataFrame, gamma: float = 0.9) -> DataFrame:
    return whiten(checkpoint(discounted_returns(tokens, gamma)), "a", "w").select("seq", "pos", (F.col("w") * F.col("mask")).alias("advantage"), F.col("a").alias("returns"))


def reward_to_go(tokens: DataFrame, value: Column) -> Column:
    return F.sum(value).over(Window.partitionBy("seq").orderBy(F.desc("pos")))


def remax(tokens: DataFrame, baseline: DataFrame) -> DataFrame:
    """Summed rewards to come less the sequence's baseline, on valid tokens. `baseline`: (seq, base)."""
    r = tokens.withColumn("returns", reward_to_go(tokens, F.col("reward") * F.col("mask")))
    return r.join(baseline, "seq").select("seq", "pos", (F.col("returns") - F.col("base") * F.col("mask")).alias("advantage"), "returns")


def process_grpo(tokens: DataFrame) -> DataFrame:
    """Token rewards normalized by the statistics of all valid tokens of the group, then summed from behind."""
    valid = tokens.filter("mask = 1").groupBy("uid").agg(F.count("*").alias("n"), F.avg("reward").alias("m"), F.stddev_samp("reward").alias("s"))
    valid = valid.select("uid", F.when(F.col("n") > 1, F.col("m")).otherwise(0.0).alias("m"), F.when(F.col("n") > 1, F.col("s")).otherwise(1.0).alias("s"))
    t = tokens.join(valid, "uid", "left")
    t = t.withColumn("x", F.when(F.col("mask") == 1, (F.col("reward") - F.col("m")) / (F.col("s") + EPS)).otherwise(0.0))
    return t.select("seq", "pos", (reward_to_go(t, F.col("x")) * F.col("mask")).alias("advantage"))


def direct_plus_grpo(tokens: DataFrame, weight: float = 1.0) -> DataFrame:
    """Token rewards on valid tokens plus the weighted group advantage of the sequence."""
    g = grpo(sequences(tokens)).select("seq", F.col("advantage").alias("g"))
    return tokens.join(g, "seq").select("seq", "pos", ((F.col("reward") + weight * F.col("g")) * F.col("mask")).alias("advantage"))


def kl_estimate(lp: Column, ref: Column, kind: str) -> Column:
    d = lp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        x = clamp(-d, -SAFE, SAFE)
        return clamp(F.exp(x) - x - 1, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind!r}")


def aggregate_loss(tokens: DataFrame, loss: Column, mask: Column, width: int) -> DataFrame:
    """The four ways to reduce token losses to one number; sequences without valid tokens do not count in means."""
    per = tokens.groupBy("seq").agg(F.sum(loss * mask).alias("s"), F.sum(mask).alias("n"))
    live = F.col("n") > 0
    return per.agg(
        (F.sum("s") / (F.sum("n") + 1e-8)).alias("token_mean"),
        (F.sum(F.when(live, F.col("s"))) / (F.count_if(live) + 1e-8)).alias("seq_mean_token_sum"),
        (F.sum(F.when(live, F.col("s") / (F.col("n") + 1e-8))) / (F.count_if(live) + 1e-8)).alias("seq_mean_token_mean"),
        (F.sum("s") / width).alias("seq_mean_token_sum_norm"),
    )


def ppo_terms(adv: Column, log_ratio: Column, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> tuple[Column, Column, Column]:
    """(loss, clipped above, clipped below) of the dual-clip objective."""
    ratio = F.exp(clamp(log_ratio, -SAFE, SAFE))
    one, two, three = -adv * ratio, -adv * clamp(ratio, 1 - low, 1 + high), -adv * c
    top = F.greatest(one, two)
    return F.when(adv < 0, F.least(three, top)).otherwise(top), (two > one).cast("int"), ((top > three) & (adv < 0)).cast("int")


def ppo_loss(tokens: DataFrame, adv: Column) -> DataFrame:
    """(pg_loss, clip_fraction, clip_fraction_lower, approx_kl) over valid tokens."""
    d, m = F.col("lp") - F.col("old_lp"), F.col("mask")
    loss, above, below = ppo_terms(adv, d)
    return tokens.agg(masked_mean(loss, m).alias("pg_loss"), masked_mean(above, m).alias("clip_fraction"), masked_mean(below, m).alias("clip_fraction_lower"), masked_mean(-clamp(d, -SAFE, SAFE), m).alias("approx_kl"))


def gspo_loss(tokens: DataFrame, adv: Column, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Loss with one importance ratio per sequence (mean log ratio of its valid tokens)."""
    t = tokens.withColumn("_a", adv)
    m = F.col("mask")
    s = t.groupBy("seq").agg((F.sum((F.col("lp") - F.col("old_lp")) * m) / F.greatest(F.sum(m), F.lit(1))).alias("d"))
    ratio = F.exp(clamp(F.col("d"), None, 10.0))
    loss = F.greatest(-F.col("_a") * ratio, -F.col("_a") * clamp(ratio, 1 - low, 1 + high))
    return aggregate_loss(t.join(s, "seq"), loss, m, 1).select(F.col("seq_mean_token_mean").alias("pg_loss"))


def geo_mean_loss(tokens: DataFrame, adv: Column, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """Loss with the geometric mean of clipped token ratios and the mean advantage of each sequence."""
    d, m = F.col("lp") - F.col("old_lp"), F.col("mask")
    t = tokens.withColumn("_a", adv).withColumn("_s", F.signum("_a"))
    least = F.col("_s") * F.least(F.col("_s") * d, F.col("_s") * clamp(d, -low, high))
    per = t.withColumn("_d", least).groupBy("seq").agg(F.sum(F.col("_d") * m).alias("d"), F.sum(F.col("_a") * m).alias("a"), F.sum(m).alias("n"))
    n = F.col("n") + 1e-8
    return per.agg(F.avg(-(F.col("a") / n) * F.exp(F.col("d") / n)).alias("pg_loss"))


def covariance(tokens: DataFrame, adv: Column) -> DataFrame:
    """Tokens with `cov`: the product of advantage and log probability, each less its mean over valid tokens."""
    t = tokens.withColumn("_a", adv)
    m = F.col("mask")
    means = t.agg(masked_mean(F.col("_a"), m).alias("_ma"), masked_mean(F.col("lp"), m).alias("_ml"))
    return _alone(means, t).withColumn("cov", (F.col("_a") - F.col("_ma")) * (F.col("lp") - F.col("_ml"))).drop("_ma", "_ml")


def _nth(keys: DataFrame, n: int) -> DataFrame:
    """(_edge): the n-th smallest k, or the largest if there are fewer; the keys are ordered by ranges, in no task as a whole."""
    return sampling.global_rank(keys.select("k.*"), keys.select("k.*").columns, "_place").filter(F.col("_place") < n).agg(F.max(F.struct(*keys.select("k.*").columns)).alias("_edge"))


def clip_cov_loss(tokens: DataFrame, adv: Column, ratio: float, low: float, high: float, seed: str) -> DataFrame:
    """Loss without a few tokens drawn (by hash) among those with covariance inside the bounds."""
    t = covariance(tokens, adv)
    r = F.exp(F.col("lp") - F.col("old_lp"))
    one, two = -F.col("_a") * r, -F.col("_a") * clamp(r, 0.8, 1.2)
    t = t.withColumn("_one", one).withColumn("_two", two)
    inside = (F.col("mask") > 0) & ~(F.col("_two") > F.col("_one")) & (F.col("cov") > low) & (F.col("cov") < high)
    rank = F.struct(F.sha2(F.concat_ws(":", F.lit(seed), "seq", "pos"), 256).alias("h"), F.col("seq"), F.col("pos"))
    wanted = F.greatest(F.floor(F.sum("mask") * ratio), F.lit(1)).cast("int")
    n = t.agg(wanted.alias("n")).first()["n"] or 1
    edge = _nth(t.filter(inside).select(rank.alias("k")), n)
    t = _alone(edge, t).withColumn("_gone", F.coalesce(inside & (rank <= F.col("_edge")), F.lit(False)).cast("int"))
    m = F.col("mask")
    return t.agg(masked_mean(F.greatest("_one", "_two") * (1 - F.col("_gone")), m).alias("pg_loss"), masked_mean(F.col("_gone"), m).alias("clip_fraction"))


def kl_cov_loss(tokens: DataFrame, adv: Column, ratio: float, coefficient: float = 1.0) -> DataFrame:
    """Loss with a divergence penalty on the share of tokens with the largest covariance."""
    t = covariance(tokens, adv)
    valid = t.filter("mask = 1")
    n = max(1, int(valid.count() * ratio))
    rank = F.struct((-F.col("cov")).alias("c"), F.col("seq"), F.col("pos"))
    edge = _nth(valid.select(rank.alias("k")), n)
    d = F.col("lp") - F.col("old_lp")
    loss = -F.col("_a") * F.exp(d) + F.when((F.col("mask") == 1) & (rank <= F.col("_edge")), coefficient * F.abs(d)).otherwise(0.0)
    return _alone(edge, t).agg(masked_mean(loss, F.col("mask")).alias("pg_loss"), masked_mean(F.abs(d), F.col("mask")).alias("abs_kl"))


def value_loss(tokens: DataFrame, prediction: Column, returns: Column, clip: float) -> DataFrame:
    v = F.col("value")
    cut = F.greatest(F.least(prediction, v + clip), v - clip)
    one, two = F.pow(prediction - returns, 2), F.pow(cut - returns, 2)
    m = F.col("mask")
    return tokens.agg((0.5 * masked_mean(F.greatest(one, two), m)).alias("vf_loss"), masked_mean((two > one).cast("int"), m).alias("vf_clip_fraction"))


def importance_weights(tokens: DataFrame, level: str, cap: float) -> DataFrame:
    """(seq, pos, weight): exponentials of log ratios, per token or summed over the sequence, cut at `cap`, 0 if masked."""
    d = F.col("lp") - F.col("old_lp")
    if level == "token":
        w = tokens.withColumn("_d", d)
    elif level == "sequence":
        s = tokens.groupBy("seq").agg(F.sum(d * F.col("mask")).alias("_d"))
        w = tokens.join(s, "seq")
    else:
        raise ValueError(f"unknown level {level!r}")
    return w.select("seq", "pos", F.least(F.exp(clamp(F.col("_d"), -SAFE, SAFE)) * F.col("mask"), F.lit(cap)).alias("weight"))


def rejection_mask(tokens: DataFrame, level: str, upper: float) -> DataFrame:
    """(seq, pos, kept): valid tokens whose ratio (token, sequence or geometric mean) lies within 1/upper and upper."""
    d, m = F.col("lp") - F.col("old_lp"), F.col("mask")
    if level == "token":
        w = tokens.withColumn("_d", d)
    else:
        total = F.sum(d * m) if level == "sequence" else F.sum(d * m) / (F.sum(m) + 1e-8)
        w = tokens.join(tokens.groupBy("seq").agg(total.alias("_d")), "seq")
    ratio = F.exp(clamp(F.col("_d"), -SAFE, SAFE))
    return w.select("seq", "pos", (m * ((ratio >= 1 / upper) & (ratio <= upper)).cast("int")).alias("kept"))


def veto(tokens: DataFrame, threshold: float) -> DataFrame:
    """(seq, vetoed): sequences with a valid token whose log ratio is below the threshold's logarithm."""
    bad = (F.col("lp") - F.col("old_lp") < F.log(F.lit(threshold))) & (F.col("mask") == 1)
    return tokens.groupBy("seq").agg(F.bool_or(bad).alias("vetoed"))


def effective_sample_size(tokens: DataFrame) -> DataFrame:
    """1 / mean of (w / mean w)^2 over valid tokens, with the weights' mean, least and largest."""
    w = F.when(F.col("mask") == 1, F.exp(clamp(F.col("lp") - F.col("old_lp"), -SAFE, SAFE)))
    return tokens.withColumn("_w", w).agg((F.pow(F.avg("_w"), 2) / F.avg(F.col("_w") * F.col("_w"))).alias("ess"), F.avg("_w").alias("mean"), F.min("_w").alias("least"), F.max("_w").alias("largest"))


def off_policy_metrics(tokens: DataFrame) -> DataFrame:
    """Perplexities of both policies by sequence, their ratio, and divergence estimates over tokens."""
    m = F.col("mask")
    per = tokens.groupBy("seq").agg(masked_mean(F.col("lp"), m).alias("a"), masked_mean(F.col("old_lp"), m).alias("b"))
    one = per.agg(F.avg(F.exp(-F.col("a"))).alias("ppl_new"), F.avg(F.exp(-F.col("b"))).alias("ppl_old"), F.avg(F.col("b") - F.col("a")).alias("log_ppl_diff"), F.avg(F.exp(F.col("b") - F.col("a"))).alias("ppl_ratio"))
    d = F.col("lp") - F.col("old_lp")
    two = tokens.agg(masked_mean(-d, m).alias("kl"), masked_mean(F.exp(d) - d - 1, m).alias("k3"), (masked_mean(F.exp(2 * d), m) - 1).alias("chi2"))
    return one.crossJoin(two)


def data_metrics(tokens: DataFrame) -> DataFrame:
    """Score, reward and length statistics of a batch of sequences."""
    s = sequences(tokens)
    live = F.col("length") > 0
    return s.agg(
        F.count("*").alias("n"), F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.min("score").alias("score_min"), F.stddev_samp("score").alias("score_std"),
        F.avg(F.abs("score")).alias("score_abs_mean"), F.count_if(F.round(F.abs("score"), 9) > 5).alias("extreme"), F.avg("length").alias("length_mean"), F.max("length").alias("length_max"), F.min("length").alias("length_min"),
        F.avg((~live).cast("int")).alias("aborted_ratio"),
    )


def explained_variance(tokens: DataFrame, returns: Column) -> DataFrame:
    r, v = F.when(F.col("mask") == 1, returns), F.when(F.col("mask") == 1, F.col("value"))
    return tokens.agg((1 - F.var_samp(r - v) / (F.var_samp(r) + 1e-5)).alias("explained_variance"))


def prefix_means(tokens: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Mean reward of valid tokens before each cutoff."""
    before = [F.avg(F.when((F.col("pos") <= c) & (F.col("mask") == 1), F.col("reward"))).alias(str(c)) for c in cutoffs]
    wide = tokens.agg(*before)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(str(c)).alias("mean_reward")) for c in cutoffs])).alias("x")).select("x.*")


def majority_value(df: DataFrame, group: str, vote: str, value: str, order: str) -> DataFrame:
    """(group, vote, value): the most frequent vote (the first seen wins ties) and the value of its first row."""
    counts = df.groupBy(group, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    best = counts.groupBy(group).agg(F.max_by(F.struct(vote, "value"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select(group, f"b.{vote}", "b.value")


def response_mask(tokens: DataFrame, end: Column) -> DataFrame:
    """(seq, pos, live): 1 up to and with the first end token."""
    w = Window.partitionBy("seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.select("seq", "pos", (F.coalesce(F.sum(end.cast("int")).over(w), F.lit(0)) == 0).cast("int").alias("live"))


def trajectory_weights(tokens: DataFrame, divergence: Column, least: float = 1e-9) -> DataFrame:
    """(seq, pos, weight): divergences shifted by one position and normalized in each sequence; uniform if they vanish."""
    w = Window.partitionBy("seq")
    t = tokens.withColumn("_d", F.coalesce(F.lag(divergence).over(w.orderBy("pos")), F.lit(0.0)) * F.col("mask"))
    t = t.withColumn("_sum", F.sum("_d").over(w)).withColumn("_n", F.sum("mask").over(w))
    uniform = F.when(F.col("_n") > 0, F.col("mask") / F.col("_n")).otherwise(0.0)
    return t.select("seq", "pos", F.when(F.col("_sum") > least, F.col("_d") / F.col("_sum")).otherwise(uniform).alias("weight"))


def kl_controller(kls: Column, start: float, target: float, horizon: int, steps: int) -> Column:
    """The coefficient after an ordered array of measured divergences: error clipped to 0.2, scaled by steps / horizon."""
    return F.aggregate(kls, F.lit(start), lambda c, k: c * (1 + clamp(k / target - 1, -0.2, 0.2) * steps / horizon))
