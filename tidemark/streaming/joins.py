"""Joins of event streams: by key over what has arrived, and by key within a time interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_join(left: DataFrame, right: DataFrame, on: str, kind: str = "inner") -> DataFrame:
    """All matches by key; kinds inner, left, and outer, which is full."""
    return left.join(right, on, {"outer": "full_outer"}.get(kind, kind))


def interval_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, before: str, after: str, kind: str = "inner") -> DataFrame:
    """Matches by key with right_time within [left_time - before, left_time + after]; columns must not clash but for the key.

    On streams both sides need a watermark, by which Spark drops state.
    """
    r = right.withColumnRenamed(on, "__key")
    span = F.col(right_time).between(F.col(left_time) - F.expr(f"INTERVAL {before}"), F.col(left_time) + F.expr(f"INTERVAL {after}"))
    return left.join(r, (F.col(on) == F.col("__key")) & span, kind).drop("__key")
