"""Accumulators over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.session import ensure_checkpoint_dir


def channel_sums(acts: DataFrame) -> DataFrame:
    """Per layer and channel: count, sum and sum of squares; works on streams (complete mode) and tables."""
    return acts.groupBy("layer", "channel").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def accumulate_files(spark: SparkSession, d: str, table: str = "embeddings") -> DataFrame:
    """Run the accumulators over a file source until it is read, and give the final state."""
    path = f"{d}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name if spark.read.format("binaryFile").load(path).limit(1).count() else "*.parquet").parquet(folder)
    acts = stream.select(F.col("label").alias("layer"), F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    sink = f"sums_{uuid.uuid4().hex}"
    state = f"{ensure_checkpoint_dir(spark)}/{sink}"
    channel_sums(acts).writeStream.format("memory").queryName(sink).outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.table(sink)
