"""Partitions of logs and their assignment to consumers."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.query import global_ordinals, grouped_ordinals


def partition_of(key: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def with_partition(df: DataFrame, key: str, n: int, partitioner: Callable[[Column, int], Column] = partition_of) -> DataFrame:
    """Every row by its own key; ``partitioner`` gives the partition of a key column."""
    return df.withColumn("partition", partitioner(F.col(key), n))


def hash_place(key: Column) -> Column:
    """The place of a key on a ring of 2^32: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def md5_partition(key: Column, n: int) -> Column:
    return F.pmod(hash_place(key), F.lit(n)).cast("int")


class Ring:
    """Consistent hashing: each node owns the arcs that end at its ``copies`` places on the ring."""

    def __init__(self, nodes: list[str], copies: int = 16):
        place = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:8], 16)
        self.places = sorted((place(f"{node}#{k}"), node) for node in nodes for k in range(copies))

    def node(self, key: Column) -> Column:
        """The node of a key: that of the next place from the key's on, around the ring."""
        ring = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.lit(n).alias("n")) for p, n in self.places])
        at = hash_place(key)
        return F.coalesce(F.get(F.filter(ring, lambda x: x.p >= at), F.lit(0)).n, F.lit(self.places[0][1]))


def partition_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def round_robin(partitions: int, consumers: list[str]) -> dict[str, list[int]]:
    order = sorted(consumers)
    return {c: [p for p in range(partitions) if p % len(order) == k] for k, c in enumerate(order)}


def contiguous(partitions: int, consumers: list[str]) -> dict[str, list[int]]:
    """Blocks; the first ones get one more if it does not divide."""
    order, at, out = sorted(consumers), 0, {}
    each, more = divmod(partitions, len(order)) if order else (0, 0)
    for k, c in enumerate(order):
        n = each + (k < more)
        out[c] = list(range(at, at + n))
        at += n
    return out


def sticky(partitions: int, consumers: list[str], previous: dict[str, list[int]] | None = None) -> dict[str, list[int]]:
    """Owners keep their partitions; free ones are dealt in turn from the first consumer on. Without a previous state: round robin."""
    order = sorted(consumers)
    if previous is None:
        return round_robin(partitions, consumers)
    out = {c: [p for p in previous.get(c, []) if p < partitions] for c in order}
    held = {p for own in out.values() for p in own}
    for k, p in enumerate([p for p in range(partitions) if p not in held] if order else []):
        out[order[k % len(order)]].append(p)
    return {c: sorted(own) for c, own in out.items()}


STRATEGIES = {"round_robin": round_robin, "range": contiguous, "sticky": sticky}


def needs_rebalancing(assigned: dict[str, list[int]], members: list[str]) -> bool:
    return set(assigned) != set(members)


def rebalance(partitions: int, members: list[str], strategy: str = "round_robin", generation: int = 0, previous: dict[str, list[int]] | None = None) -> tuple[dict[str, list[int]], int]:
    """(assignment, next generation); the sticky strategy keeps what ``previous`` gives."""
    own = sticky(partitions, members, previous) if strategy == "sticky" else STRATEGIES[strategy](partitions, members)
    return own, generation + 1


class Group:
    """A consumer group: members join and leave, each change deals the partitions anew and raises the generation."""

    def __init__(self, partitions: int, strategy: str = "sticky"):
        self.partitions, self.strategy, self.generation = partitions, strategy, 0
        self.assigned: dict[str, list[int]] = {}

    def _deal(self, members: list[str]) -> dict[str, list[int]]:
        if needs_rebalancing(self.assigned, members):
            self.assigned, self.generation = rebalance(self.partitions, members, self.strategy, self.generation, self.assigned or None)
        return self.assigned

    def join(self, member: str) -> dict[str, list[int]]:
        return self._deal([*self.assigned, member] if member not in self.assigned else list(self.assigned))

    def leave(self, member: str) -> dict[str, list[int]]:
        return self._deal([m for m in self.assigned if m != member])


def assignment_rows(spark: SparkSession, assigned: dict[str, list[int]]) -> DataFrame:
    return spark.createDataFrame([(c, p) for c, own in assigned.items() for p in own], "consumer string, partition int")


class Ranges:
    """Partitions by boundaries: partition k holds keys from boundary k-1 (included) to boundary k."""

    def __init__(self, boundaries: list):
        self.boundaries = sorted(boundaries)

    def partition(self, key) -> int:
        return bisect_right(self.boundaries, key)

    def column(self, key: Column) -> Column:
        out = F.lit(0)
        for b in self.boundaries:
            out = out + (key >= F.lit(b)).cast("int")
        return out

    def within(self, low, high) -> list[int]:
        """Partitions that [low, high) may touch."""
        last = bisect_right(self.boundaries, high)
        if last and self.boundaries[last - 1] == high:
            last -= 1
        return list(range(self.partition(low), max(self.partition(low), last) + 1))

    def split(self, boundary) -> Ranges:
        return Ranges([*self.boundaries, boundary]) if boundary not in self.boundaries else self

    def merge(self, boundary) -> Ranges:
        return Ranges([b for b in self.boundaries if b != boundary])


def append_partitioned(rows: DataFrame, n: int, order: str, key: str | None = None, chunks: bool = False) -> DataFrame:
    """``rows`` with partition and, in each, a 0-based seq.

    By key; else dealt by ``order`` in turn, or with ``chunks`` in ``n`` runs of like size. No partition is gathered in one task.
    """
    if key:
        return _numbered(with_partition(rows, key, n), order)
    placed = global_ordinals(rows, [F.col(order)], "__n")
    if not chunks:
        return placed.withColumns({"partition": F.pmod("__n", F.lit(n)).cast("int"), "seq": F.floor(F.col("__n") / n).cast("long")}).drop("__n")
    total = placed.agg(F.count("*").alias("__all"))
    size = F.greatest(F.ceil(F.col("__all") / n), F.lit(1))
    return placed.join(F.broadcast(total)).withColumns({"partition": F.floor(F.col("__n") / size).cast("int"), "seq": (F.col("__n") % size).cast("long")}).drop("__n", "__all")  # one row


def _numbered(dealt: DataFrame, order: str) -> DataFrame:
    return grouped_ordinals(dealt, "partition", [F.col(order)], "seq").withColumn("seq", F.col("seq").cast("long"))
