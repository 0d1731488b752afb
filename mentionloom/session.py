"""Session helpers: where lineage is cut, and how much data there is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> SparkSession:
    """Settings without which results are wrong: in Spark 4.1 a union may claim a partitioning that only one of its sides has, and a later grouping then skips the shuffle it needs."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; only a local session, where none is named, gets one of its own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{ensure_checkpoint_dir(settle(spark))}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(settle(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same as a compressed table, for wide rows."""
    df.write.parquet(path := shared_path(df.sparkSession, name))
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{folder}/{name}.parquet")
