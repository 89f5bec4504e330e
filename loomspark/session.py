"""Session helpers shared by operators and queries."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names in spark.checkpoint.dir.

    Only in local mode, where that setting is absent (tests), a temporary folder of the machine is set; on a cluster its
    absence is an error, as a folder of one machine would lose what other executors wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    where = named or os.path.join(tempfile.gettempdir(), f"loomspark-checkpoint-{os.getpid()}")
    if not named:
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    context.setCheckpointDir(where)
    return where


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files make fewer: for work that is heavy per row.

    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which a counted side of a join is broadcast.
FEW_ROWS = 200_000


def broadcast_if_few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A side of a join: broadcast if a count finds it small, left to a shuffled join otherwise."""
    return F.broadcast(df) if df.count() <= most else df
