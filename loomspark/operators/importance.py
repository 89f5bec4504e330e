"""Channel importance, orders, masks and their comparison, over long tables of activations and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def minitron(acts: DataFrame) -> DataFrame:
    """(layer, channel, score): root of summed squares, over samples, of mean absolute activations over tokens."""
    per = acts.groupBy("layer", "channel", "sample").agg(F.avg(F.abs("x")).alias("m"))
    return per.groupBy("layer", "channel").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("score"))


def activation_statistics(acts: DataFrame, norms: DataFrame) -> DataFrame:
    """(layer, channel, wanda, wifv, wifn): norm times root mean square, variance times squared norm, mean size times norm."""
    n = F.count("*")
    s = acts.groupBy("layer", "channel").agg(n.alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.abs("x")).alias("a"))
    j = s.join(norms, ["layer", "channel"])
    variance = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    return j.select("layer", "channel", (F.col("norm") * F.sqrt(F.col("q") / F.col("n"))).alias("wanda"), (variance * F.col("norm") * F.col("norm")).alias("wifv"), (F.col("a") / F.col("n") * F.col("norm")).alias("wifn"))


def column_norms(weights: DataFrame) -> DataFrame:
    return weights.groupBy("layer", "channel").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def taylor(weights: DataFrame, batches: int) -> DataFrame:
    """(layer, channel, first_order, second_order) from weights w and gradients g."""
    x = F.col("w") * F.col("g")
    return weights.groupBy("layer", "channel").agg((F.sum(F.abs(x)) / batches).alias("first_order"), (0.5 * F.sum(x * x) / batches).alias("second_order"))


def channel_order(scores: DataFrame, score: str) -> DataFrame:
    """(layer, channel, rank): channels of each layer by score, ties by channel."""
    w = Window.partitionBy("layer").orderBy(F.desc(score), "channel")
    return scores.select("layer", "channel", (F.row_number().over(w) - 1).alias("rank"))


def keep_size(original: Column, ratio: float, multiple: int) -> Column:
    """The nearest multiple to what is left after pruning, within one multiple and the whole."""
    raw = F.floor(original * (1 - ratio) / multiple + 0.5) * multiple
    return F.least(F.greatest(raw, F.lit(multiple)), original).cast("int")


def nested_masks(order: DataFrame, ratios: list[float], multiple: int) -> DataFrame:
    """(ratio, layer, channel): the channels kept at each ratio."""
    sizes = order.groupBy("layer").agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), keep_size(F.col("n"), r, multiple).alias("keep")) for r in ratios]))
    return order.join(sizes.select("layer", wanted.alias("k")), "layer").filter("rank < k.keep").select("k.ratio", "layer", "channel")


def nesting_violations(masks: DataFrame) -> DataFrame:
    """Channels kept at some ratio but not at the next smaller one: none if the masks are nested."""
    ratios = masks.select("ratio").distinct().withColumn("before", F.lag("ratio").over(Window.orderBy("ratio"))).filter("before is not null")
    inner = masks.join(F.broadcast(ratios), "ratio")
    outer = masks.select(F.col("ratio").alias("before"), "layer", "channel")
    return inner.join(outer, ["before", "layer", "channel"], "left_anti").select("ratio", "layer", "channel")


def compare_masks(left: DataFrame, right: DataFrame, channels: DataFrame) -> DataFrame:
    """(layer, removed_left, removed_right, shared, overlap, replacement) of the removed channels of two masks."""
    gone = [channels.join(m.select("layer", "channel"), ["layer", "channel"], "left_anti").withColumn(n, F.lit(1)) for m, n in ((left, "l"), (right, "r"))]
    j = gone[0].join(gone[1], ["layer", "channel"], "full")
    s = j.groupBy("layer").agg(F.count("l").alias("removed_left"), F.count("r").alias("removed_right"), F.count(F.col("l") + F.col("r")).alias("shared"))
    overlap = F.col("shared") / F.greatest("removed_left", F.lit(1))
    return s.withColumn("overlap", overlap).withColumn("replacement", 1 - overlap)


def rank_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Correlation of two orders' ranks per layer."""
    j = left.join(right.select("layer", "channel", F.col("rank").alias("other")), ["layer", "channel"])
    return j.groupBy("layer").agg(F.corr("rank", "other").alias("rank_correlation"))


def shifted(logits: DataFrame, columns: list[str]) -> DataFrame:
    """Logits less the largest of their position, so that no exponential overflows."""
    w = Window.partitionBy("sample", "pos")
    return logits.select(*[c for c in logits.columns if c not in columns], *[(F.col(c) - F.max(c).over(w)).alias(c) for c in columns])


def token_statistics(logits: DataFrame, chosen: Column, top_p: float) -> DataFrame:
    """(sample, pos, entropy, logprob, kept, inside): of each position its entropy, the log probability of the chosen token,
    how many tokens the nucleus of mass `top_p` holds, and whether the chosen one is among them.
    """
    w = Window.partitionBy("sample", "pos")
    lp = shifted(logits, ["teacher"]).withColumn("_chosen", F.col("token") == chosen)
    lp = lp.withColumn("lp", F.col("teacher") - F.log(F.sum(F.exp("teacher")).over(w))).withColumn("p", F.exp("lp"))
    order = w.orderBy(F.desc("p"), "token").rowsBetween(Window.unboundedPreceding, -1)
    lp = lp.withColumn("_in", F.coalesce(F.sum("p").over(order), F.lit(0.0)) < top_p)
    return lp.groupBy("sample", "pos").agg((-F.sum(F.col("p") * F.col("lp"))).alias("entropy"), F.max(F.when(F.col("_chosen"), F.col("lp"))).alias("logprob"), F.count_if("_in").alias("kept"), F.bool_or(F.col("_chosen") & F.col("_in")).alias("inside"))


def forward_kl(logits: DataFrame, k: int, floor: float = 1e-12) -> DataFrame:
    """(sample, pos, kl): divergence of teacher from probe on the teacher's k likeliest tokens and one for all others."""
    w = Window.partitionBy("sample", "pos")
    p = shifted(logits, ["teacher", "probe"])
    soft = lambda c: F.exp(c) / F.sum(F.exp(c)).over(w)
    p = p.withColumn("_p", soft("teacher")).withColumn("_q", soft("probe"))
    p = p.withColumn("_r", F.row_number().over(w.orderBy(F.desc("teacher"), "token")))
    top = F.col("_r") <= k
    g = p.groupBy("sample", "pos").agg(
        F.collect_list(F.when(top, F.struct(F.greatest("_p", F.lit(floor)).alias("p"), F.greatest("_q", F.lit(floor)).alias("q")))).alias("t"),
        F.greatest(1 - F.sum(F.when(top, F.col("_p"))), F.lit(floor)).alias("op"),
        F.greatest(1 - F.sum(F.when(top, F.col("_q"))), F.lit(floor)).alias("oq"),
    )
    g = g.withColumn("t", F.concat("t", F.array(F.struct(F.col("op").alias("p"), F.col("oq").alias("q")))))
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda a, x: a + x[f])
    g = g.withColumn("sp", total("p")).withColumn("sq", total("q"))
    kl = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["p"] / F.col("sp") * (F.log(x["p"] / F.col("sp")) - F.log(x["q"] / F.col("sq"))))
    return g.select("sample", "pos", F.greatest(kl, F.lit(0.0)).alias("kl"))


def parameter_breakdown(params: DataFrame) -> DataFrame:
    """(kind, n_parameters, share) by patterns of parameter names."""
    kind = F.when(F.col("name").like("%mlp%"), "ffn").when(F.col("name").like("%attn%"), "attention").when(F.col("name").like("%embed%"), "embedding").otherwise("other")
    g = params.groupBy(kind.alias("kind")).agg(F.sum("size").alias("n_parameters"))
    total = g.agg(F.sum("n_parameters").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select("kind", "n_parameters", (F.col("n_parameters") / F.col("_t")).alias("share"))
