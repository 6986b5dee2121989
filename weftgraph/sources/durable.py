"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")).rstrip("/")


def cut(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: its rows no longer depend on what made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
