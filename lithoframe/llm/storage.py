"""Where jobs cut their lineage: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a session without that setting (as in tests) gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir() + "/lithoframe-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cut lineage that survives a lost executor."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
