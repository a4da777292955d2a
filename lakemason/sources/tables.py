"""Reading tables of one scale directory, and helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of this machine only in local mode (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the one the session names; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), f'lakemason-checkpoints-{os.getpid()}')}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the reliable checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def widen(df: DataFrame) -> DataFrame:
    """Few bytes, much work: as many tasks as the session shuffles into, not as few as their size asks for.

    A partition count that is named is one the adaptive planner leaves alone.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def spread(df: DataFrame, cores_hint: int = 3) -> DataFrame:
    """Give CPU-heavy Python stages enough tasks when a small file arrives as few splits.

    The number of splits follows the scheduler's parallelism, never the data; large
    inputs already come in more splits than that and pass through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * cores_hint
    return df if df.rdd.getNumPartitions() >= want // cores_hint else df.repartition(want)
