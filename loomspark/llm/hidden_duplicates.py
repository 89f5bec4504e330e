"""Records that are the same but for formatting: white space, case, punctuation, field order.

Every record becomes a set of (field name, normalized value) pairs. A field that holds a JSON object contributes one
pair per member, so the order of members cannot matter. Each pair is hashed, the hashes are combined by a commutative
multiset hash (addition modulo 2**62 in two independent lanes), records are grouped by that fingerprint, and members of
a group are compared with its keeper as sets of pairs: nothing is sorted. The fingerprints are written once; the pairs are
made again only for the rows of groups.

Skew. The grouping is a map-side combined min/count. Groups holding more than a thousandth of all rows (fewer than 1000
by that definition, three numbers each) are attached by broadcast; the comparison with the keeper replicates each
keeper in proportion to its group and spreads the copies over the replicas.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.session import broadcast_if_few, checkpoint

#: Unicode classes that carry meaning; everything else is formatting.
IGNORED = r"[^\p{L}\p{M}\p{N}\p{S}]+"
MASK = (1 << 62) - 1
#: Copies that one replica of a keeper is compared with.
COPIES_PER_REPLICA = 20_000
#: Groups from this size on, and larger than a thousandth of all copies, are attached by broadcast.
HOT_GROUP = 20_000


def fold(value: Column) -> Column:
    """Letters, marks, digits and symbols in order, in upper case (there one-to-many pairs such as ß and SS meet)."""
    return F.regexp_replace(F.upper(value), IGNORED, "")


def json_members(text: str | None) -> list[str] | None:
    """The members of a JSON object as normalized `name value` strings, numbered among equals; None if it is none."""
    import regex

    ignored = _compiled(regex)

    def norm(x: str) -> str:
        return ignored.sub("", x.upper())

    class Pairs(list):
        pass

    def canonical(value) -> str:
        if isinstance(value, Pairs):
            counts = Counter(f"{norm(k)}\x1f{canonical(v)}" for k, v in value)
            return "\x1e" + "\x1e".join(sorted(f"{k}\x1f{n}" for k, n in counts.items()))
        if isinstance(value, list):
            return "\x1d" + "\x1d".join(canonical(v) for v in value)
        if value is True or value is False:
            return "true" if value else "false"
        return "null" if value is None else norm(value)

    if text is None:
        return None
    try:
        value = json.loads(text.strip(), object_pairs_hook=Pairs, parse_int=str, parse_float=str, parse_constant=str)
        if not isinstance(value, Pairs):
            return None
        seen: Counter[str] = Counter()
        out = []
        for k, v in value:
            pair = f"{norm(k)}\x1f{canonical(v)}"
            seen[pair] += 1
            out.append(f"{pair}\x1f{seen[pair]}")
        return out
    except (ValueError, RecursionError):
        return None


_COMPILED: list = []


def _compiled(regex):
    if not _COMPILED:
        _COMPILED.append(regex.compile(IGNORED))
    return _COMPILED[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _members(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json_members(t) if t is not None else None)


def _named(members: Column, name: str) -> Column:
    return F.transform(members, lambda m: F.concat(F.lit(name), m))


def fingerprinted(df: DataFrame, id_col: str, fields: Sequence[str], json_fields: Sequence[str]) -> DataFrame:
    """(id, pairs, fp1, fp2) of the rows that can have copies."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(fields)])
    rows = rows.filter(F.col("id").isNotNull())
    parts = []
    for i, c in enumerate(fields):
        v = F.col(f"v{i}")
        rows = rows.filter(v.isNotNull())
        plain = F.array(F.concat(F.lit(f"{i}\x1f"), fold(v)))
        if c in json_fields:
            rows = rows.filter(v.rlike(r"[\p{L}\p{N}]"))
            like = F.ltrim(v, F.lit(" \t\r\n")).startswith("{")
            rows = rows.withColumn(f"m{i}", _members(F.when(like, v)))
            members = _named(F.col(f"m{i}"), f"{i}.\x1f")
            parts.append(F.when(F.col(f"m{i}").isNull(), plain).otherwise(members))
        else:
            parts.append(plain)
    rows = rows.select("id", F.concat(*parts).alias("pairs"))

    def lane(seed: int) -> Column:
        return F.aggregate(
            "pairs", F.lit(0).cast("long"), lambda a, x: (a + F.xxhash64(F.lit(seed), x).bitwiseAND(MASK)).bitwiseAND(MASK)
        )

    return rows.select("id", "pairs", lane(11).alias("fp1"), lane(29).alias("fp2"))


def hidden_duplicates(df: DataFrame, id_col: str = "row_id", fields: Sequence[str] = ("source_id", "prompt"), json_fields: Sequence[str] = ("prompt",)) -> DataFrame:
    """(keep_id, copy_id): each copy with the smallest id of its set of copies.

    Null in any field, or a JSON-capable field without letter or digit: no copies. Null ids are left out. An id that is
    delivered again is not a copy of itself. Records without copies and empty tables give no rows. Further columns of
    `df` are never touched, whatever their names.
    """
    prints = checkpoint(fingerprinted(df, id_col, fields, json_fields).select("id", "fp1", "fp2"))
    groups = checkpoint(prints.groupBy("fp1", "fp2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1"))
    copies_total, largest = (x or 0 for x in groups.agg(F.sum("n"), F.max("n")).first())
    hot_from = max(HOT_GROUP, copies_total // 1000)  # fewer than 1000 groups can be larger
    hot = groups.filter(F.col("n") > hot_from)
    cold = groups.filter(F.col("n") <= hot_from)
    replicas = F.ceil(F.col("n") / COPIES_PER_REPLICA).cast("int")

    def grouped(rows: DataFrame) -> DataFrame:
        """Rows of the groups, with keep_id and n."""
        if largest <= hot_from:
            return rows.join(cold, ["fp1", "fp2"])
        others = rows.join(F.broadcast(hot.select("fp1", "fp2")), ["fp1", "fp2"], "left_anti").join(cold, ["fp1", "fp2"])
        return others.unionByName(rows.join(F.broadcast(hot), ["fp1", "fp2"]))

    # Only rows of groups are read for their pairs: the others have no copies.
    ids = broadcast_if_few(checkpoint(grouped(prints).select(F.col("id").alias(id_col)).distinct()))
    wanted = df.select(*dict.fromkeys([id_col, *fields])).join(ids, id_col, "left_semi")
    members = checkpoint(grouped(fingerprinted(wanted, id_col, fields, json_fields)))
    keepers = members.filter("id = keep_id").dropDuplicates(["fp1", "fp2"]).select("fp1", "fp2", F.col("pairs").alias("kept"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("slot"))
    copies = members.filter("id <> keep_id").withColumn("slot", F.pmod(F.xxhash64("id"), replicas).cast("int"))
    same = (F.size("pairs") == F.size("kept")) & (F.size(F.array_except("pairs", "kept")) == 0) & (F.size(F.array_except("kept", "pairs")) == 0)
    compared = checkpoint(copies.join(keepers, ["fp1", "fp2", "slot"]).withColumn("same", same).select("id", "keep_id", "same", F.when(~same, F.col("pairs")).alias("pairs")))

    # A fingerprint shared by different records (never seen, 124 bits): these few are grouped by their own pairs.
    strays = compared.filter(~F.col("same")).withColumn("pairs", F.array_sort("pairs"))
    regrouped = strays.groupBy("keep_id", "pairs").agg(F.min("id").alias("first_id"))
    again = strays.join(regrouped, ["keep_id", "pairs"]).filter("id <> first_id").select(F.col("first_id").alias("keep_id"), F.col("id").alias("copy_id"))
    found = compared.filter("same").select("keep_id", F.col("id").alias("copy_id")).unionByName(again)
    return found.distinct()


def collapsed(df: DataFrame, id_col: str = "row_id", fields: Sequence[str] = ("source_id", "prompt"), json_fields: Sequence[str] = ("prompt",)) -> DataFrame:
    """Every record once: (row_id, n_copies), n_copies counting the record itself."""
    pairs = hidden_duplicates(df, id_col, fields, json_fields)
    counts = pairs.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))
    ids = df.select(F.col(id_col).alias("row_id")).filter("row_id is not null").distinct()
    return (
        ids.join(pairs.select(F.col("copy_id").alias("row_id")), "row_id", "left_anti")
        .join(counts.withColumnRenamed("keep_id", "row_id"), "row_id", "left")
        .select("row_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    )
