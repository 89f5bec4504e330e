"""Deterministic sampling by hash rank: deduplication, quotas, interleaving, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text
from loomspark.session import broadcast_if_few, checkpoint

#: Hash ranks are counted by their first digits, in so many buckets.
BUCKET_DIGITS = 4


def stable_rank(seed: str, *parts: Column) -> Column:
    """sha256 of the seed and the parts, joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def hash_number(seed: str, *parts: Column) -> Column:
    """A whole number below 2**60 from the seed and the parts."""
    return F.conv(F.substring(stable_rank(seed, *parts), 1, 15), 16, 10).cast("bigint")


def row_rank(seed: str, source: Column, source_id: Column, prompt: Column) -> Column:
    return stable_rank(seed, source, source_id, F.substring(prompt, 1, 256))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Written as a minimum, so that it combines before the shuffle and no key is sorted."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*order, *[c for c in others if c not in order])
    got = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return got.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _cut(df: DataFrame, n: Column, rank: Column, tie: str | None, group: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows surely among the n lowest of their group, rows to be decided (`_n` of them up to `_need`), rows surely beyond.

    Ranks are hashes: counts of their first digits (65,536 buckets a group at most) tell the bucket in which the n-th
    lies, and only rows of that bucket are ordered. No group is sorted, and only rows of that bucket are shuffled.
    """
    key = F.to_json(F.struct(*group)) if group else F.lit("")
    rows = df.withColumn("_group", key).withColumn("_rank", rank).withColumn("_bucket", F.conv(F.substring("_rank", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("_group", "_bucket").agg(F.count("*").alias("_count"), F.max(n).alias("_wanted"))
    counts = counts.withColumn("_upto", F.sum("_count").over(Window.partitionBy("_group").orderBy("_bucket")))
    below = F.col("_upto") <= F.col("_wanted")
    edges = counts.groupBy("_group").agg(F.min(F.when(~below, F.col("_bucket"))).alias("_edge"), (F.max("_wanted") - F.coalesce(F.max(F.when(below, F.col("_upto"))), F.lit(0))).alias("_need"))
    rows = rows.join(broadcast_if_few(edges), "_group")
    inside = Window.partitionBy("_group").orderBy("_rank", *([tie] if tie else []))
    decided = rows.filter("_bucket = _edge").withColumn("_n", F.row_number().over(inside))
    return rows.filter("_edge is null or _bucket < _edge"), decided, rows.filter("_bucket > _edge")


_CUT = ("_group", "_rank", "_bucket", "_edge", "_need", "_n")


def lowest(df: DataFrame, n: int | Column, rank: Column, tie: str | None = None, group: list[str] | None = None) -> DataFrame:
    """The n rows with the lowest hash ranks, of each group if there are groups (null is one); n may be a column of the group."""
    sure, decided, _ = _cut(df, n if isinstance(n, Column) else F.lit(n), rank, tie, group or [])
    return sure.drop(*_CUT).unionByName(decided.filter("_n <= _need").drop(*_CUT))


def quota_sample(df: DataFrame, quota: int, rank: Column, stratum: Column | None = None, tie: str | None = None) -> DataFrame:
    """`quota` rows by hash rank, in turn from each stratum; the column `position` gives their order.

    With strata the rows are numbered within each, and the order by (number, stratum) takes one of each in turn.
    """
    ties = [tie] if tie else []
    if stratum is None:
        picked = lowest(df, quota, rank, tie).withColumn("_rank", rank)
        return global_rank(picked, ["_rank", *ties], "position").withColumn("position", F.col("position") + 1).drop("_rank")
    rows = lowest(df.withColumn("_stratum", F.coalesce(stratum.cast("string"), F.lit(""))), quota, rank, tie, ["_stratum"])
    rows = interleave(rows, "_stratum", rank, tie, "_turn")
    picked = global_rank(rows, ["_turn", "_stratum"], "position").filter(F.col("position") < quota)
    return picked.withColumn("position", F.col("position") + 1).drop("_turn", "_stratum")


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with the place (from 0) of each row in the order of the columns, which must tell all rows apart.

    Rows are range-partitioned and numbered within their range; the sizes of the ranges before are added. No task sorts
    more than a range. The ranges are written once, as a second evaluation could draw other bounds.
    """
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    # One row for each partition of the shuffle, whose number is a setting and not a matter of the data.
    return ranged.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_range", "_before")


def inverse_permutation(df: DataFrame, index: str, tie: str, out: str) -> DataFrame:
    """df with the place of each row in the order of `index`, whose values must be 0 to n - 1, each once."""
    n, low, high, distinct = df.agg(F.count("*"), F.min(index), F.max(index), F.countDistinct(index)).first()
    if n and (low, high, distinct) != (0, n - 1, n):
        raise ValueError(f"{index} is no permutation: {n} rows, {distinct} distinct values from {low} to {high}")
    return global_rank(df, [index, tie], out)


def interleave(df: DataFrame, domain: str, rank: Column, tie: str | None, turn: str = "turn") -> DataFrame:
    """(columns, turn): one row of each domain per turn, domains in order within a turn.

    The place within a domain is the place in the order of all less that of the domain's first, so that a domain may
    hold most of the rows.
    """
    placed = global_rank(df.withColumn("_rank", rank), [domain, "_rank", *([tie] if tie else [])], "_place")
    first = placed.groupBy(F.col(domain).alias("_domain")).agg(F.min("_place").alias("_first"))
    joined = placed.join(broadcast_if_few(first), F.col(domain).eqNullSafe(F.col("_domain")))
    return joined.withColumn(turn, F.col("_place") - F.col("_first") + 1).drop("_rank", "_place", "_first", "_domain")


def resamples(df: DataFrame, group: str, value: str, tie: str, size: int, times: int, seed: int) -> DataFrame:
    """(group, resample, draw, value): `times` samples of `size` values of each group, with replacement; null values are none.

    Places are drawn by hash and joined to the rows, so that no group is gathered; `tie` tells all rows apart.
    """
    placed = global_rank(df.filter(F.col(value).isNotNull()).select(group, value, tie), [group, value, tie], "_place")
    groups = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    draws = groups.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(size))))
    draws = draws.select("resample", "draw", (F.col("_first") + hash_number(str(seed), F.col("_group"), F.col("resample"), F.col("draw")) % F.col("_n")).alias("_place"))
    return draws.join(placed.select("_place", group, value), "_place").select(group, "resample", "draw", value)


def weighted_draws(df: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """(draw, key): n draws with replacement, by whole weights; draws are numbered from 0, `key` tells all rows apart.

    Rows own intervals of the running sum of the weights, cut where equal slices of the whole end; a draw looks its number
    up among the intervals of its slice. So a row may own most of the weight, and no task holds more than its share.
    """
    rows = running_sum(df.select(key, weight.cast("bigint").alias("_w")).filter("_w > 0"), "_w", [key], "_upto")
    total = rows.agg(F.max("_upto")).first()[0] or 0
    if total == 0:
        return rows.select(F.lit(0).cast("bigint").alias("draw"), key).limit(0)
    width = max(1, total // max(1, n))
    low, high = F.col("_upto") - F.col("_w"), F.col("_upto") - 1
    cut = rows.withColumn("_slice", F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))).select(key, low.alias("_low"), "_upto", "_slice")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (hash_number(seed, F.col("id")) % total).alias("_u"))
    met = draws.withColumn("_slice", F.floor(F.col("_u") / width)).join(cut, "_slice")
    return met.filter("_u >= _low and _u < _upto").select("draw", key)


def running_sum(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """df with the sum of a column up to and with each row, in the order of columns that tell all rows apart; by ranges."""
    ranged = checkpoint(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_range", "_before")


def first_n_split(df: DataFrame, n: int, rank: Column, tie: str, names: tuple[str, str] = ("sft", "opd")) -> DataFrame:
    """Rows with the column `part`: the first n by hash rank, and the rest."""
    sure, decided, beyond = _cut(df, F.lit(n), rank, tie, [])
    parts = sure.withColumn("part", F.lit(names[0])), decided.withColumn("part", F.when(F.col("_n") <= F.col("_need"), names[0]).otherwise(names[1])), beyond.withColumn("part", F.lit(names[1]))
    first, *others = (x.drop(*_CUT) for x in parts)
    return first.unionByName(others[0]).unionByName(others[1])


def balanced_sample(df: DataFrame, total: int, domain: str, rank: Column, tie: str) -> DataFrame:
    """`total` rows spread evenly over the domains, however many; the remainder goes to the first domains in order."""
    rows = df.filter(F.col(domain).isNotNull())
    places = checkpoint(global_rank(rows.select(domain).distinct(), [domain], "_k"))
    count = places.count()
    base, extra = divmod(total, max(1, count))
    wanted = places.select(domain, (F.lit(base) + (F.col("_k") < extra).cast("int")).alias("_share"))
    return lowest(rows.join(broadcast_if_few(wanted), domain), F.col("_share"), rank, tie, [domain]).select(*df.columns)


def up_to_n(df: DataFrame, n: int, domain: str, rank: Column, tie: str) -> DataFrame:
    """At most n rows of each domain."""
    return lowest(df, n, rank, tie, [domain])


def drop_reserved(df: DataFrame, reserved: DataFrame, text_col: str) -> DataFrame:
    """Rows whose normalized text is not among the reserved ones."""
    keys = reserved.select(text.normalize(F.col(text_col)).alias("_key")).filter("_key is not null").distinct()
    return df.withColumn("_key", text.normalize(F.col(text_col))).join(keys, "_key", "left_anti").drop("_key")


def primary_wins(primary: DataFrame, supplement: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both, one row per key, those of the primary first."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(supplement.withColumn("_p", F.lit(1)))
    return keep_first(both, keys, ["_p", *order]).drop("_p")


def van_der_corput(k: Column, bits: int = 32) -> Column:
    """The base-2 low-discrepancy point of k."""
    bit = F.lit(1).cast("long")
    return sum((F.shiftright(k.cast("long"), i).bitwiseAND(bit) * F.lit(0.5 ** (i + 1)) for i in range(bits)), F.lit(0.0))


def window_offsets(n: int, span: int) -> list[int]:
    """n evenly spread offsets over a span, both ends included, without repeats."""
    return sorted({round(i * span / (n - 1)) for i in range(n)}) if n > 1 else [0]


def systematic_sample(df: DataFrame, position: str, n: int, span: int) -> DataFrame:
    return df.filter(F.col(position).isin(window_offsets(n, span)))


def windows_until(df: DataFrame, position: str, key: str, window: int, need: int, max_windows: int) -> DataFrame:
    """Rows of the windows that are read, in van der Corput order, until `need` distinct keys have been seen.

    Distinct keys are counted by the window in which each is first seen; only the counts of windows are ordered.
    """
    rows = df.withColumn("chunk", F.floor(F.col(position) / window)).withColumn("turn", van_der_corput(F.col("chunk")))
    first = rows.groupBy(key).agg(F.min("turn").alias("turn"))
    counts = rows.groupBy("turn").agg(F.lit(0).cast("long").alias("zero")).join(first.groupBy("turn").count(), "turn", "left").select("turn", F.coalesce("count", "zero").alias("fresh"))
    order = Window.orderBy("turn")
    counts = counts.orderBy("turn").limit(max_windows)  # further windows are never read
    counts = counts.withColumn("before", F.coalesce(F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    read = counts.filter(F.col("before") < need).select("turn")
    return rows.join(read, "turn", "left_semi").drop("turn")


def quota_by_domain(df: DataFrame, quota: int, domain: str, stratum: Column, rank: Column, tie: str) -> DataFrame:
    """For each domain `quota` rows by hash rank, in turn from its strata, with their `position`.

    No more than `quota` rows of a stratum reach the windows, and Catalyst limits each domain to `quota` before it sorts.
    """
    rows = lowest(df.withColumn("_stratum", F.coalesce(stratum.cast("string"), F.lit(""))), quota, rank, tie, [domain, "_stratum"]).withColumn("_rank", rank)
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(domain, "_stratum").orderBy("_rank", tie)))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(domain).orderBy("_turn", "_stratum", tie))).filter(F.col("position") <= quota)
    return rows.drop("_rank", "_stratum", "_turn")
