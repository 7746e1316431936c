"""Consumer groups over a log (collection, partition, seq, ...) and a table of committed offsets.

Offsets (group, collection, partition, position) hold the next seq to read. They are a table of their own, apart from
the checkpoints of streaming queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS = "group string, collection string, partition int, position long"
EARLIEST, LATEST, NONE = "earliest", "latest", "none"


def starting_positions(log: DataFrame, offsets: DataFrame, group: str, reset: str = EARLIEST) -> DataFrame:
    """(collection, partition, position): committed, else by the reset rule; ``none`` raises where nothing is committed."""
    ends = log.groupBy("collection", "partition").agg((F.max("seq") + 1).alias("end"))
    own = offsets.filter(F.col("group") == group).select("collection", "partition", "position")
    joined = ends.join(own, ["collection", "partition"], "left")
    missing = {EARLIEST: F.lit(0).cast("long"), LATEST: F.col("end"), NONE: F.raise_error(F.lit(f"group {group} has no committed offset")).cast("long")}[reset]
    return joined.select("collection", "partition", F.when(F.col("position").isNull(), missing).otherwise(F.col("position")).alias("position"))


def poll(log: DataFrame, positions: DataFrame, most: int, deletes: bool = False) -> DataFrame:
    """Up to ``most`` rows of each partition from its position, in order; deletes are skipped unless asked for."""
    rows = log.join(F.broadcast(positions), ["collection", "partition"]).filter(F.col("seq") >= F.col("position")).drop("position")  # a row per partition
    if not deletes and "op" in log.columns:
        rows = rows.filter("op != 'delete'")
    place = F.row_number().over(Window.partitionBy("collection", "partition").orderBy("seq"))
    return rows.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")


def advanced(log: DataFrame, positions: DataFrame, most: int) -> DataFrame:
    """Positions after a poll: past its last row, or past all that was only deletes."""
    seen = poll(log, positions, most).groupBy("collection", "partition").agg((F.max("seq") + 1).alias("read"), F.count("*").alias("n"))
    ends = log.groupBy("collection", "partition").agg((F.max("seq") + 1).alias("end"))
    both = positions.join(seen, ["collection", "partition"], "left").join(ends, ["collection", "partition"], "left")
    full = F.coalesce(F.col("n"), F.lit(0)) >= most
    return both.select("collection", "partition", F.when(full, F.col("read")).otherwise(F.greatest("position", "end")).alias("position"))


def commit(offsets: DataFrame, group: str, positions: DataFrame) -> DataFrame:
    """The offsets table with a group's new positions."""
    new = positions.select(F.lit(group).alias("group"), "collection", "partition", "position")
    return offsets.join(new, ["group", "collection", "partition"], "left_anti").select(*offsets.columns).unionByName(new)


def seek(positions: DataFrame, position: int) -> DataFrame:
    return positions.withColumn("position", F.lit(position).cast("long"))


def position(positions: DataFrame) -> DataFrame:
    """The smallest over a consumer's partitions."""
    return positions.agg(F.min("position").alias("position"))


def lag(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """(group, collection, partition, latest, committed, lag), not below 0."""
    ends = log.groupBy("collection", "partition").agg((F.max("seq") + 1).alias("latest"))
    joined = offsets.join(ends, ["collection", "partition"], "left")
    latest = F.coalesce("latest", F.lit(0))
    return joined.select("group", "collection", "partition", latest.alias("latest"), F.col("position").alias("committed"), F.greatest(latest - F.col("position"), F.lit(0)).alias("lag"))


def reset_offsets(offsets: DataFrame, log: DataFrame, group: str, target: int | None = None, collection: str | None = None) -> DataFrame:
    """A group's offsets set to ``target``, or to the log's ends."""
    ends = log.groupBy("collection", "partition").agg((F.max("seq") + 1).alias("__end"))
    hit: Column = F.col("group") == group
    if collection is not None:
        hit = hit & (F.col("collection") == collection)
    new = F.lit(target).cast("long") if target is not None else F.coalesce("__end", F.lit(0))
    return offsets.join(ends, ["collection", "partition"], "left").withColumn("position", F.when(hit, new).otherwise(F.col("position"))).select(*offsets.columns)


def close(offsets: DataFrame, group: str, positions: DataFrame) -> DataFrame:
    """The offsets after a consumer's last commit; what it held is free from then on."""
    return commit(offsets, group, positions)


def groups(offsets: DataFrame) -> DataFrame:
    return offsets.select("group").distinct()


def group_offsets(offsets: DataFrame, group: str) -> DataFrame:
    return offsets.filter(F.col("group") == group)


def delete_group(offsets: DataFrame, group: str) -> DataFrame:
    return offsets.filter(F.col("group") != group)


def reassigned(positions: DataFrame, assigned: DataFrame, offsets: DataFrame, group: str) -> DataFrame:
    """Positions for a new set of partitions: kept ones stay, new ones are committed or 0, removed ones go."""
    own = offsets.filter(F.col("group") == group).select("collection", "partition", F.col("position").alias("__committed"))
    joined = assigned.join(positions, ["collection", "partition"], "left").join(own, ["collection", "partition"], "left")
    return joined.select("collection", "partition", F.coalesce("position", "__committed", F.lit(0)).cast("long").alias("position"))
