"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a temporary folder of this machine only where a local session sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.environ.get("SRCLOOM_SCRATCH") or tempfile.mkdtemp(prefix="spark-srcloom-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, short lineage, readable after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/srcloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def even_partitions(total: int, each: int, least: int = 1) -> int:
    """How many partitions hold about `each` of `total` units, so that work per task stays level as data grow."""
    return max(least, -(-total // each))


def bucketed(df: DataFrame, name: str, key: str | tuple[str, ...], buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """`df` as a table in the shared folder that is bucketed by `key`, sorted within by `order`: joins by the key move only their other side.

    Give rows whose tasks hold few values of the key each, or rows dealt by it, as every task writes one file for each bucket it meets.
    """
    spark = df.sparkSession
    unique = f"srcloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
    keys = (key,) if isinstance(key, str) else key
    writer = df.write.format("parquet").bucketBy(buckets, *keys)
    writer = writer.sortBy(*order) if order else writer
    writer.option("path", f"{shared_folder(spark)}/{unique}").saveAsTable(unique)
    return spark.table(unique)
