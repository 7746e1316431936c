"""Change logs: folding them into state, retention, compaction and dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.query import grouped_ordinals


def replay(log: DataFrame, key: str, delta: str) -> DataFrame:
    """(key, total) from the whole log, from nothing; running it again gives the same."""
    return log.groupBy(key).agg(F.sum(delta).alias("total"))


def replay_fold(log: DataFrame, key: str, seq: str, initial: Column, step: Callable[[Column, Column], Column], columns: list[str]) -> DataFrame:
    """(key, state): an order-dependent fold of each key's events."""
    item = F.struct(seq, *columns)
    rows = log.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select(key, F.aggregate("items", initial, step).alias("state"))


def snapshot_and_compact(log: DataFrame, upto: int, key: str, delta: str, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(state up to an offset, log beyond it)."""
    return replay(log.filter(F.col(seq) <= upto), key, delta), log.filter(F.col(seq) > upto)


def resume(snapshot: DataFrame, log: DataFrame, key: str, delta: str) -> DataFrame:
    """State from a snapshot and the log beyond it."""
    return snapshot.unionByName(replay(log, key, delta)).groupBy(key).agg(F.sum("total").alias("total"))


def drain_since(log: DataFrame, since_ms: int, time_ms: str) -> DataFrame:
    return log.filter(F.col(time_ms) >= since_ms)


def compact_log(log: DataFrame, upto: int, seq: str = "seq") -> DataFrame:
    return log.filter(F.col(seq) > upto)


@dataclass(frozen=True)
class RetentionPolicy:
    """``max_age_ms`` drops older events, ``max_count`` all but the newest; ``min_keep`` newest stay; ``batch`` bounds drops."""

    max_age_ms: int | None = None
    max_count: int | None = None
    min_keep: int = 0
    batch: int | None = None

    def dropped(self, log: DataFrame, topic: str, time_ms: str, seq: str, now_ms: int) -> DataFrame:
        old = F.lit(False)
        if self.max_age_ms is not None:
            old = old | (F.col(time_ms) < now_ms - self.max_age_ms)
        if self.max_count is not None:
            old = old | (F.col("__new") > self.max_count)
        placed = grouped_ordinals(log, topic, [F.desc(seq)], "__new").withColumn("__new", F.col("__new") + 1)
        gone = placed.filter(old & (F.col("__new") > self.min_keep)).drop("__new")
        if self.batch is not None:
            gone = grouped_ordinals(gone, topic, [F.col(seq)], "__n").filter(F.col("__n") < self.batch).drop("__n")
        return gone

    def apply(self, log: DataFrame, topic: str, time_ms: str, seq: str, now_ms: int) -> DataFrame:
        return log.join(self.dropped(log, topic, time_ms, seq, now_ms).select(topic, seq), [topic, seq], "left_anti").select(*log.columns)


# -- dead letters ------------------------------------------------------------------------------------------------------


def process(rows: DataFrame, outcome: Column, max_retries: int, use_dlq: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processed, to retry, dead letters) of rows (.., retries) by an outcome ok, retry or dlq.

    A retry at the limit goes to the dead letters, or is dropped without them.
    """
    judged = rows.withColumn("__o", outcome)
    spent = (F.col("__o") == "retry") & (F.col("retries") + 1 >= max_retries)
    ok = judged.filter("__o = 'ok'").drop("__o")
    again = judged.filter((F.col("__o") == "retry") & ~spent).withColumn("retries", F.col("retries") + 1).drop("__o")
    dead = judged.filter((F.col("__o") == "dlq") | spent) if use_dlq else judged.limit(0)
    return ok, again, dead.withColumn("error", F.when(F.col("__o") == "dlq", "sent to the dead letters").otherwise("retries are spent")).drop("__o")


def processing_stats(rows: DataFrame, outcome: Column, max_retries: int, use_dlq: bool = True) -> DataFrame:
    """(processed, retries, dlq_sent, dropped, success_rate); a retry that is the last counts too; the rate of nothing is 1.0."""
    spent = (F.col("__o") == "retry") & (F.col("retries") + 1 >= max_retries)
    dead = (F.col("__o") == "dlq") | spent
    sums = rows.withColumn("__o", outcome).agg(
        F.count_if(F.col("__o") == "ok").alias("processed"), F.count_if(F.col("__o") == "retry").alias("retries"),
        F.count_if(dead & F.lit(use_dlq)).alias("dlq_sent"), F.count_if(dead & F.lit(not use_dlq)).alias("dropped"), F.count("*").alias("__n"),
    )
    return sums.withColumn("success_rate", F.when(F.col("__n") == 0, 1.0).otherwise(F.col("processed") / F.col("__n"))).drop("__n")


def drain_dead_letters(dead: DataFrame, succeeds: Column, max_attempts: int) -> tuple[DataFrame, DataFrame]:
    """(redelivered, remaining): successes leave; failures count an attempt until the limit, where they stay as they are."""
    ok = F.coalesce(succeeds, F.lit(False))
    left = dead.filter(~ok).withColumn("attempts", F.when(F.col("attempts") + 1 < max_attempts, F.col("attempts") + 1).otherwise(F.col("attempts")))
    return dead.filter(ok), left


# -- streaming -------------------------------------------------------------------------------------------------------


def watch(changes: DataFrame, prefix: str = "", from_offset: int | None = None) -> DataFrame:
    """Changes of keys with a prefix, beyond an offset; batch or stream."""
    out = changes.filter(F.col("key").startswith(prefix)) if prefix else changes
    return out if from_offset is None else out.filter(F.col("seq") > from_offset)


def run_pipeline(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, retries: int = 3, backoff_s: float = 0.05, once: bool = True) -> StreamingQuery:
    """Feeds micro-batches to ``sink(rows, batch_id)``, which must be idempotent by batch id, with retries and growing pauses."""

    def attempt(rows: DataFrame, batch_id: int) -> None:
        for k in range(retries + 1):
            try:
                return sink(rows, batch_id)
            except Exception:
                if k == retries:
                    raise
                time.sleep(backoff_s * 2**k)

    writer = stream.writeStream.foreachBatch(attempt).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def change_rows(rows: DataFrame, pk: str, order: str, deleted: Column | None = None) -> DataFrame:
    """(key, seq, op, value): an event per put row; rows that are ``deleted`` are tombstones without a value."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    return rows.select(F.col(pk).cast("string").alias("key"), F.col(order).cast("long").alias("seq"), F.when(gone, "delete").otherwise("put").alias("op"), F.when(~gone, F.to_json(F.struct(*rows.columns))).alias("value"))


def write_with_changes(table: str, changes: str, pk: str, order: str, deleted: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that writes the put rows and the change rows of all, each under the batch's own folder, so that a repeat overwrites."""

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        put = rows.filter(~F.coalesce(deleted, F.lit(False))) if deleted is not None else rows
        put.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        change_rows(rows, pk, order, deleted).write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")
        rows.unpersist()

    return sink


def event_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of a table's files as they come; ``files_per_batch`` limits the rate, and what comes meanwhile is one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def handled(rows: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], op: str = "op") -> DataFrame:
    """Rows of each kind of change through its handler (on_put, on_delete); kinds without one are left out."""
    parts = [handler(rows.filter(F.col(op) == kind)) for kind, handler in handlers.items()]
    return reduce(DataFrame.unionByName, parts)


def save_state(state: DataFrame, upto: int, path: str) -> None:
    """State of all events up to an offset, under that offset's folder."""
    state.write.mode("overwrite").parquet(f"{path}/upto={upto}")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(state, offset) of the latest saved state."""
    saved = spark.read.parquet(path)
    upto = saved.agg(F.max("upto")).first()[0]
    return saved.filter(F.col("upto") == upto).drop("upto"), int(upto)


def snapshot_job(log: DataFrame, path: str, upto: int, key: str, delta: str, seq: str = "seq") -> DataFrame:
    """One run of a scheduled snapshot: saves the state up to an offset and gives the log that remains."""
    state, rest = snapshot_and_compact(log, upto, key, delta, seq)
    save_state(state, upto, path)
    return rest


def running_totals(stream: DataFrame, key: str, delta: str) -> DataFrame:
    """Keyed state as a streaming aggregation (update mode)."""
    return stream.groupBy(key).agg(F.sum(delta).alias("total"), F.count("*").alias("events"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One event per key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
