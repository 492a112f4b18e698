"""Parquet tables of one data directory, and where a job may cut its lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


@functools.lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """Where jobs write what they cut their lineage at: the folder `spark.checkpoint.dir` names, which a cluster points
    at storage all executors share. Only a local master may do without, and gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder: its lineage ends there, and lost executors cost no recomputation.

    Unlike `checkpoint()`, which runs a job once to count and once more to write, the rows are computed once, and the
    table's size is known to whatever joins it.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` in at least as many partitions as there are cores.

    Files that cannot be split (one row group) would otherwise leave most cores idle in stages that
    do heavy work on each row. Inputs of enough files are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)
