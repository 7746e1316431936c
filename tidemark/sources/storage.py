"""Where intermediate tables go: the shared folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or SparkConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    made = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    spark.sparkContext._conf.set("spark.checkpoint.dir", made)  # none is set: tests and single machines
    return made


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: fixed rows, cut lineage, safe from lost executors."""
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
