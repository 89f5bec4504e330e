"""Batch algebra over tables with an explicit row order (`ord`), and load balancing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_rows(df: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    return df.filter((F.col("ord") >= start) & (F.col("ord") < stop) & ((F.col("ord") - start) % step == 0))


def chunk(df: DataFrame, n: int, chunks: int) -> DataFrame:
    """Rows of a table of n rows with the number of their chunk; n must divide evenly."""
    if n % chunks:
        raise ValueError(f"{n} rows do not divide into {chunks}")
    return df.withColumn("chunk", F.floor(F.col("ord") / (n // chunks)).cast("int"))


def split_rows(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("part", F.floor(F.col("ord") / size).cast("int"))


def repeat_rows(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row `times` times; the copies stand together (interleave) or the whole table is repeated."""
    r = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return r.withColumn("place", F.col("ord") * times + F.col("copy") if interleave else F.col("copy") * F.lit(1_000_000_000_000) + F.col("ord"))


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    return df.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def unfold_chunks(df: DataFrame, column: str, n: int) -> DataFrame:
    """An array column cut into n equal pieces, one row each."""
    size = F.size(column) / n
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(column), (i * size + 1).cast("int"), size.cast("int")))
    return df.select("*", F.posexplode(pieces).alias("piece", "values")).drop(column)


def pad_to_divisor(df: DataFrame, n: int, divisor: int) -> DataFrame:
    """Rows with `is_pad`: the first rows are appended until the number divides evenly."""
    missing = -n % divisor
    pads = df.filter(F.col("ord") < missing).withColumn("ord", F.col("ord") + n).withColumn("is_pad", F.lit(True))
    return df.withColumn("is_pad", F.lit(False)).unionByName(pads)


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both by row; columns that both have must agree."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c != key])
    j = left.join(r, key)
    for c in shared:
        j = j.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(j.schema[c].dataType)))
    return j.drop(*[f"_r_{c}" for c in shared])


def pad_array(column: Column, length: int, value: Column) -> Column:
    return F.slice(F.concat(column, F.array_repeat(value, F.greatest(F.lit(length) - F.size(column), F.lit(0)))), 1, length)


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Indices in k parts of nearly equal sums, by the largest differencing method."""
    states = [(0, i, [(s, [i]) if p == 0 else (0, []) for p in range(k)]) for i, s in enumerate(sizes)]
    heap = [(-(max(x[0] for x in parts) - min(x[0] for x in parts)), i, parts) for _, i, parts in states]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        a, b = sorted(a, key=lambda x: -x[0]), sorted(b, key=lambda x: x[0])
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b)]
        n += 1
        heapq.heappush(heap, (-(max(x[0] for x in merged) - min(x[0] for x in merged)), n, merged))
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_parts(sizes: list[int], k: int) -> list[list[int]]:
    """Indices in k parts: each goes, largest first, to the part with the least load."""
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + sizes[i], p))
    return [sorted(p) for p in parts]


def token_budget_batches(sizes: list[int], budget: int) -> list[list[int]]:
    """Micro-batches whose token sums keep a budget: as many parts as the sum needs, balanced, and more if one exceeds it."""
    k = max(1, -(-sum(sizes) // budget))
    while k < len(sizes) and any(sum(sizes[i] for i in p) > budget for p in karmarkar_karp(sizes, k)):
        k += 1
    return karmarkar_karp(sizes, k)


def balanced_parts(df: DataFrame, group: str, key: str, size: str, k: int, method: str = "kk") -> DataFrame:
    """(group, key, part): the rows of each group spread over k parts. A group is one batch, held by one task: the caller bounds its rows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key).reset_index(drop=True)
        sizes = [int(x) for x in g[size]]
        parts = karmarkar_karp(sizes, k) if method == "kk" else greedy_parts(sizes, k) if method == "greedy" else token_budget_batches(sizes, k)
        where = {i: p for p, members in enumerate(parts) for i in members}
        return pd.DataFrame({group: g[group], key: g[key], "part": [where[i] for i in range(len(g))]})

    types = dict(df.dtypes)
    return df.select(group, key, size).groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, `{key}` {types[key]}, part int")


def batches_of(df: DataFrame, size: int, epochs: int) -> DataFrame:
    """(epoch, batch, ord): rows in mini-batches over several epochs, an incomplete last batch dropped."""
    n = df.agg(F.max("ord").alias("_n"))
    e = df.crossJoin(F.broadcast(n)).filter(F.floor(F.col("ord") / size) < F.floor((F.col("_n") + 1) / size)).drop("_n")
    return e.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("batch", F.floor(F.col("ord") / size).cast("int"))


def iterate(df: DataFrame) -> Iterator:
    """Rows one by one without collecting the table."""
    return df.orderBy("ord").toLocalIterator()


def concat(parts: list[tuple[DataFrame, dict]]) -> tuple[DataFrame, dict]:
    """Batches (rows, facts) put together by rows: a column that one lacks is null there; facts are merged, and must agree."""
    rows, facts = parts[0][0], dict(parts[0][1])
    for more, others in parts[1:]:
        for name, value in others.items():
            if name in facts and facts[name] != value:
                raise ValueError(f"batches disagree on {name!r}: {facts[name]!r} and {value!r}")
        facts |= others
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows, facts


def collate(df: DataFrame, batch: str, key: str, values: str, fill: Column) -> DataFrame:
    """(batch, width, rows): the arrays of a batch by key, each filled up to the longest of the batch."""
    g = df.groupBy(batch).agg(F.max(F.size(values)).alias("width"), F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(values).alias("values")))).alias("rows"))
    filled = F.transform("rows", lambda r: F.struct(r["key"].alias("key"), F.concat(r["values"], F.array_repeat(fill, F.col("width") - F.size(r["values"]))).alias("values")))
    return g.select(batch, "width", filled.alias("rows"))
