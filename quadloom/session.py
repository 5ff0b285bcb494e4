"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and everything runs on one machine, as in tests, is a folder of our own made, and
    removed at exit. On a cluster a missing setting is an error, as no other executor could read a local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quadloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared checkpoint folder and continue from the files.

    Unlike a cache, the result survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a bounded count proves that `df` has at most `limit` rows; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def computed_once(column: Column) -> Column:
    """`column`, so that a filter on what is made of it is applied after it is computed.

    The optimizer moves filters below the columns they use and writes the definition of a column into each use, so a
    costly match would run many times a row. It leaves columns alone that are not deterministic, as this one claims to be.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out to all cores if it comes in fewer than half as many pieces, as from one small file.

    For heavy work by row only: input of many files or row groups is read as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
