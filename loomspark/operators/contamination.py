"""Which prompts stand in an evaluation set: exact search over word shingles.

Candidates are pairs that share a shingle; items too short to have one are found by the words between their first and
last, those of one or two (long) words by pieces of them, so that no pair is formed without evidence. A pair is `exact` if
one text contains the other (both of 48 characters or more), else `near_duplicate` if the Jaccard similarity of the
shingles reaches the threshold.

Prompts are normalized once and written to the checkpoint folder; shared shingles are counted by their 64-bit hashes in
the join that finds them. Items are the small side: their shingles are broadcast if a count finds them few, so that a
sentence that many prompts share makes no hot key; otherwise both sides are shuffled, and the shingles that many items
share are spread over parts of the prompts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text
from loomspark.session import broadcast_if_few, checkpoint, spread

THRESHOLD = 0.6
SHORT_MATCH = 200
#: Parts of the prompts over which shingles are spread where the items' shingles are too many to broadcast.
SALTS = 16


def _words(normalized):  # noqa: ANN001, ANN202
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def _within(short: DataFrame, long: DataFrame, short_id: str, long_id: str, sizes: list[int]) -> DataFrame:
    """(short_id, long_id) where the normalized text of `short` may lie inside that of `long`.

    A text of n words (3 to 12, of the sizes given) shows by one run, its n - 2 inner words: those at its ends may be cut.
    """
    inner = short.filter(F.size("w").isin(sizes)).select(short_id, (F.size("w") - 2).alias("size"), F.xxhash64(F.slice("w", F.lit(2), F.size("w") - 2)).alias("g"))

    def sized(n: int):  # noqa: ANN202
        return F.transform(text.gram_hashes(F.col("w"), n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("g")))

    outer = text.explode_once(long, F.concat(*[sized(n - 2) for n in sizes]), "x", long_id).select(long_id, "x.*")
    return inner.join(outer, ["size", "g"]).select(short_id, long_id)


def _within_long_words(short: DataFrame, long: DataFrame, short_id: str, long_id: str) -> DataFrame:
    """The same for texts of one or two words, of `MIN_CONTAINED` characters or more.

    A single word lies inside a word: it shows by its first characters, against all stretches of that length. Of two words
    one has at least half the characters: the first ends a word, or the second begins one.
    """
    size, half = text.MIN_CONTAINED, (text.MIN_CONTAINED - 1) // 2
    w, none = F.col("w"), F.array().cast("array<struct<kind:int,g:string>>")

    def piece(kind: int, g) -> Column:  # noqa: ANN001
        return F.struct(F.lit(kind).alias("kind"), g.alias("g"))

    first, second = F.get(w, 0), F.get(w, 1)
    # Both halves show where both are long enough; one is enough to be found.
    two = F.when(F.length(first) >= half, piece(1, F.right(first, F.lit(half)))).otherwise(piece(2, F.left(second, F.lit(half))))
    inner = short.filter((F.size(w) <= 2) & (F.length(F.array_join(w, " ")) >= size)).select(short_id, F.when(F.size(w) == 1, piece(0, F.left(first, F.lit(size)))).otherwise(two).alias("x"))

    def pieces(word: Column) -> Column:
        n = F.length(word)
        inside = F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: piece(0, F.substring(word, i, F.lit(size))))).otherwise(none)
        return F.concat(inside, F.when(n >= half, F.array(piece(1, F.right(word, F.lit(half))), piece(2, F.left(word, F.lit(half))))).otherwise(none))

    outer = text.explode_once(long, F.flatten(F.transform(F.filter(w, lambda x: F.length(x) >= half), pieces)), "x", long_id)
    return inner.select(short_id, "x.*").join(outer.select(long_id, "x.*"), ["kind", "g"]).select(short_id, long_id)


def _shared_shingles(p: DataFrame, b: DataFrame) -> DataFrame:
    """(prompt_id, item_id, common, np, nb): how many distinct shingles two texts share, and have."""

    def side(df: DataFrame, name: str, count: str) -> DataFrame:
        grams = df.select(name, text.gram_hashes(F.col("w"), text.SHINGLE).alias("gs")).select(name, F.size("gs").alias(count), F.explode_outer("gs").alias("g"))
        return grams.filter("g is not null")

    ps, bs = side(p, "prompt_id", "np"), checkpoint(side(b, "item_id", "nb"))
    few = broadcast_if_few(bs)
    if few is bs:
        salt = F.pmod(F.xxhash64("prompt_id"), F.lit(SALTS)).cast("int")
        often = bs.groupBy("g").agg((F.count("*") > SALTS).alias("often"))
        parts = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
        hot = often.filter("often").select("g", "often")
        few = bs.join(often, "g").withColumn("salt", F.explode(parts)).drop("often")
        ps = ps.join(hot, "g", "left").withColumn("salt", F.when(F.col("often"), salt).otherwise(-1)).drop("often")
        met = ps.join(few, ["g", "salt"])
    else:
        met = ps.join(few, "g")
    return met.groupBy("prompt_id", "item_id").agg(F.count("*").alias("common"), F.first("np").alias("np"), F.first("nb").alias("nb"))


def contamination_matches(prompts: DataFrame, items: DataFrame, prompt_id: str, prompt_text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(prompt_id, item_id, benchmark, benchmark_index, level, score, matched_characters) of every match.

    `items` has item_id, benchmark, benchmark_index, text. Null texts match nothing.
    """
    p = spread(prompts.filter(F.col(prompt_text).isNotNull()).select(F.col(prompt_id).alias("prompt_id"), F.col(prompt_text).alias("p")))
    p = checkpoint(p.withColumn("p", text.normalize(F.col("p")))).withColumn("w", _words(F.col("p")))
    b = items.filter("text is not null").select("item_id", "benchmark", "benchmark_index", text.normalize(F.col("text")).alias("b"))
    b = checkpoint(b).withColumn("w", _words(F.col("b")))
    short_items = b.filter(F.size("w") < text.SHINGLE)
    short_prompts = p.filter((F.size("w") < text.SHINGLE) & (F.length("p") >= text.MIN_CONTAINED))
    sizes = sorted(r[0] for r in short_items.filter(F.length("b") >= text.MIN_CONTAINED).select(F.size("w")).distinct().collect())  # at most thirteen
    bare = _within(short_prompts, short_items, "prompt_id", "item_id", list(range(3, text.SHINGLE))).unionByName(_within_long_words(short_prompts, short_items, "prompt_id", "item_id"))
    if wide := [n for n in sizes if n >= 3]:
        bare = bare.unionByName(_within(short_items, p, "item_id", "prompt_id", wide).select("prompt_id", "item_id"))
    if any(n in (1, 2) for n in sizes):
        bare = bare.unionByName(_within_long_words(short_items, p, "item_id", "prompt_id").select("prompt_id", "item_id"))
    none = F.lit(0).cast("int")
    candidates = checkpoint(_shared_shingles(p, b).unionByName(bare.distinct().select("prompt_id", "item_id", F.lit(0).cast("bigint").alias("common"), none.alias("np"), none.alias("nb"))))
    some = broadcast_if_few(candidates.select("prompt_id").distinct())
    full = candidates.join(p.select("prompt_id", "p").join(some, "prompt_id", "left_semi"), "prompt_id").join(b.drop("w"), "item_id")
    exact = text.contained(F.col("p"), F.col("b"))
    score = F.when(exact, 1.0).otherwise(F.col("common") / F.greatest(F.col("np") + F.col("nb") - F.col("common"), F.lit(1)))
    full = full.withColumn("level", F.when(exact, "exact").when((F.col("common") > 0) & (score >= threshold), "near_duplicate")).withColumn("score", F.round(score, 4))
    return full.filter("level is not null").select("prompt_id", "item_id", "benchmark", "benchmark_index", "level", "score", F.least(F.length("p"), F.length("b")).alias("matched_characters"))


def candidate_texts(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """(left_id, right_id, p, q) of the texts that share a run of `size` words; both sides have an id and normalized text."""
    a, b = (d.select(F.col(k).alias(f"{s}_id"), F.col(t).alias(n)) for d, k, t, s, n in ((left, left.columns[0], left.columns[1], "left", "p"), (right, right.columns[0], right.columns[1], "right", "q")))
    grams = [text.explode_once(d, text.gram_hashes(_words(F.col(n)), size), "g", k) for d, n, k in ((a, "p", "left_id"), (b, "q", "right_id"))]
    pairs = checkpoint(grams[0].join(broadcast_if_few(checkpoint(grams[1])), "g").select("left_id", "right_id").distinct())
    return pairs.join(a.filter("p is not null"), "left_id").join(b.filter("q is not null"), "right_id")


def strongest(matches: DataFrame) -> DataFrame:
    """The match of each prompt with the highest score (then benchmark and index), and the number of its matches."""
    by = Window.partitionBy("prompt_id")
    order = by.orderBy(F.desc("score"), "benchmark", "benchmark_index", "item_id")
    return matches.withColumn("rank", F.row_number().over(order)).withColumn("total_matches", F.count("*").over(by)).filter("rank = 1").drop("rank")


def contamination_report(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark: items, distinct items hit, their share, prompts hit, hits by level, hits of short spans."""
    sizes = items.groupBy("benchmark").agg(F.count("*").alias("items"))
    hits = matches.groupBy("benchmark").agg(
        F.countDistinct("benchmark_index").alias("items_hit"),
        F.countDistinct("prompt_id").alias("prompts_hit"),
        F.count_if(F.col("level") == "exact").alias("exact_hits"),
        F.count_if(F.col("level") == "near_duplicate").alias("near_hits"),
        F.count_if(F.col("matched_characters") < SHORT_MATCH).alias("short_hits"),
        F.array_join(F.array_sort(F.collect_set("benchmark_index")), ",").alias("hit_indices"),
    )
    zero = ["items_hit", "prompts_hit", "exact_hits", "near_hits", "short_hits"]
    out = sizes.join(hits, "benchmark", "left").fillna(0, zero).fillna("", ["hit_indices"])
    return out.withColumn("hit_share", F.round(F.col("items_hit") / F.col("items"), 9))


def disjointness(left: DataFrame, right: DataFrame, text_col: str) -> DataFrame:
    """Distinct prompt hashes of both sides and how many they share."""
    a, b = (d.filter(F.col(text_col).isNotNull()).select(text.prompt_hash(F.col(text_col)).alias("h")).distinct() for d in (left, right))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "h", "full")
    return both.agg(F.count("l").alias("left_prompts"), F.count("r").alias("right_prompts"), F.count(F.col("l") + F.col("r")).alias("overlap"))
