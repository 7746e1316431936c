"""Event-time windows; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, field: str, late: str | None = None) -> DataFrame:
    """``df`` with its time as an instant (a watermark needs one) and, for streams, a bound on lateness."""
    out = df.withColumn(field, F.col(field).cast("timestamp"))
    return out.withWatermark(field, late) if late else out


def tumbling(df: DataFrame, time: str, length: str, *aggregates: Column, by: list[str] = ()) -> DataFrame:
    """(window_start, window_end, keys, aggregates); windows without rows do not appear."""
    return _flat(df.groupBy(F.window(time, length), *by).agg(*aggregates), by)


def sliding(df: DataFrame, time: str, length: str, slide: str, *aggregates: Column, by: list[str] = ()) -> DataFrame:
    return _flat(df.groupBy(F.window(time, length, slide), *by).agg(*aggregates), by)


def session(df: DataFrame, time: str, gap: str, *aggregates: Column, by: list[str] = ()) -> DataFrame:
    return _flat(df.groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggregates), by)


def window_items(df: DataFrame, time: str, length: str, order: str, columns: list[str]) -> DataFrame:
    """(window_start, window_end, items): each window's rows in order."""
    item = F.struct(order, *[c for c in columns if c != order])
    return _flat(df.groupBy(F.window(time, length)).agg(F.array_sort(F.collect_list(item)).alias("items")), [])


def _flat(df: DataFrame, by) -> DataFrame:
    rest = [c for c in df.columns if c not in ("window", *by)]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *rest)
