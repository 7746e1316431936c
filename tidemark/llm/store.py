"""Where operators cut lineage: the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one under /tmp/checkpoints for a local session; on a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or SparkConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return str(current.get())
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        found = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: compact, and safe from lost executors."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder, for small and iterative frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """``cut`` for frames that come from their own last round.

    A checkpointed frame keeps the size that was estimated for its plan, which for a join is the product of its sides: from
    round to round the estimate's digits double, until they alone fill the driver. Here they are dropped with the plan.
    """
    held = cut(df)
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(held._jdf.queryExecution().toRdd(), held._jdf.schema(), False), session)
