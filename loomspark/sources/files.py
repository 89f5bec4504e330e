"""Readers, writers, digests and manifests."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines of one or several files; lines that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, skip_corrupt: bool = False) -> DataFrame:
    """Parquet files with the columns asked for; corrupt files fail, or are skipped on request."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """JSON files of a tree by name, with the path of each."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))


def cached_or(spark: SparkSession, path: str, schema: T.StructType, make) -> DataFrame:  # noqa: ANN001
    """The cached JSON lines if they can be read and have the schema's fields, else what `make` gives, cached."""
    try:
        df = spark.read.json(path)
        if {f.name for f in schema} <= set(df.columns):
            return spark.read.schema(schema).json(path)
    except Exception:  # noqa: BLE001 - any unreadable cache is a miss
        pass
    make().write.mode("overwrite").json(path)
    return spark.read.schema(schema).json(path)


def write_ordered(df: DataFrame, path: str, order: Sequence[str], files: int = 1) -> None:
    """Parquet in the order of the columns; a job's output appears whole or not at all."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_text_atomically(text: str, path: str) -> None:
    folder = os.path.dirname(path) or "."
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def dump_json(value: object, path: str) -> None:
    write_text_atomically(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", path)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)))
        return out

    return df.select(*walk(df.schema, ()))


def _blocks(df: DataFrame, group: list[str], fanout: int) -> DataFrame:
    """(group, _at, _d) of the blocks above rows (group, _at, _d): a digest of the digests of each `fanout` of them."""
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_d"))), lambda x: x["_d"]), "\n")
    return df.groupBy(*group, F.floor(F.col("_at") / fanout).alias("_block")).agg(F.sha2(inside, 256).alias("_d")).withColumnRenamed("_block", "_at")


def ordered_digest(df: DataFrame, key: str, order: str, group: Sequence[str] = (), fanout: int = 1024) -> DataFrame:
    """(group, digest, blocks): a digest of the keys by their places (from 0, each once), for each group if there are any.

    A tree of digests: each is of up to `fanout` below it, until one is left, so that no task holds more. Equal tables
    have equal digests, whatever their partitions.
    """
    group = list(group)
    last = df.agg(F.max(order)).first()[0] or 0
    leaves = _blocks(df.select(*group, F.col(order).alias("_at"), F.col(key).cast("string").alias("_d")), group, fanout)
    last, root = last // fanout, leaves
    while True:
        root, last = _blocks(root, group, fanout), last // fanout
        if last == 0:
            break
    sizes = df.groupBy(*group, F.floor(F.col(order) / fanout).alias("_at")).agg(F.lit(1).alias("_one")).groupBy(*group).agg(F.count("*").alias("blocks"))
    if not group:
        return root.select(F.col("_d").alias("digest")).crossJoin(F.broadcast(sizes))  # one row each
    return root.select(*group, F.col("_d").alias("digest")).join(sizes, group)


def signature(*parts: Column) -> Column:
    """sha256 of the parts with zero bytes between."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def missing_shards(done: DataFrame, n: int, size: int) -> DataFrame:
    """(start, stop) of half-open ranges of rows that no complete shard covers; `done`: (start, stop)."""
    wanted = done.sparkSession.range(0, -(-n // size)).select((F.col("id") * size).alias("start"), F.least((F.col("id") + 1) * size, F.lit(n)).alias("stop"))
    return wanted.join(done, ["start", "stop"], "left_anti")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest) of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))


def catalogue(items: DataFrame, known: Sequence[tuple[str, bool]], wanted: Sequence[str]) -> DataFrame:
    """Items of the wanted benchmarks, with `graded`, and answers only where they are graded; unknown names fail."""
    flags = dict(known)
    if unknown := set(wanted) - set(flags):
        raise ValueError(f"unknown benchmarks {sorted(unknown)}")
    graded = F.col("benchmark").isin([n for n, g in known if g])
    rows = items.filter(F.col("benchmark").isin(list(wanted)))
    return rows.withColumn("graded", graded).withColumn("answer", F.when(F.col("graded"), F.col("answer")))
