"""Writes as functions from a collection to its next version; nothing is changed in place.

An upsert is an anti join and a union, so unmatched rows are not rewritten column by column; updates are ``when`` per
column. Change rows (seq, op, key, value) can be derived from two versions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_of(rows: DataFrame, pk: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order`` (without one, any of the repeated rows)."""
    if order is None:
        return rows.dropDuplicates([pk])
    return rows.groupBy(F.col(pk).alias("__k")).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends; ids are not checked (see ``unique_violations``)."""
    return df.unionByName(rows, allowMissingColumns=True)


def upsert(df: DataFrame, rows: DataFrame, pk: str, order: str | None = None) -> DataFrame:
    """Rows of the same key are replaced, others appended; of several new rows of a key the last by ``order`` wins."""
    new = latest_of(rows, pk, order)
    return df.join(new.select(pk), pk, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def upsert_counts(df: DataFrame, rows: DataFrame, pk: str) -> DataFrame:
    """(updated, inserted) of an upsert."""
    new = rows.select(pk).distinct().join(df.select(F.col(pk)).distinct().withColumn("__old", F.lit(True)), pk, "left")
    return new.agg(F.count("__old").alias("updated"), F.count_if(F.col("__old").isNull()).alias("inserted"))


def update_where(df: DataFrame, predicate: Column | str, **values: Column) -> DataFrame:
    """Columns of matching rows set to expressions of the old row; a null predicate does not match."""
    match = F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.when(match, (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def update(df: DataFrame, pk: str, key, **values: Column) -> DataFrame:
    return update_where(df, F.col(pk) == F.lit(key), **values)


def delete(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(pk), pk, "left_anti").select(*df.columns)


def delete_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    match = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(match, F.lit(False)))


def soft_delete(df: DataFrame, predicate: Column | str, mark: str = "deleted") -> DataFrame:
    return update_where(df, predicate, **{mark: F.lit(True)})


def restore(df: DataFrame, predicate: Column | str, mark: str = "deleted") -> DataFrame:
    return update_where(df, predicate, **{mark: F.lit(False)})


# -- checks and hooks ----------------------------------------------------------------------------------------------


def with_errors(rows: DataFrame, checks: dict[str, list[tuple[Column, str]]]) -> DataFrame:
    """``rows`` with errors: "field: message" of each check (a condition that must be true) that fails; null fails."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{field}: {message}")) for field, own in checks.items() for ok, message in own]
    return rows.withColumn("errors", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def insert_validated(df: DataFrame, rows: DataFrame, checks: dict[str, list[tuple[Column, str]]]) -> tuple[DataFrame, DataFrame]:
    """(collection with the good rows, rejected rows with error text)."""
    judged = with_errors(rows, checks)
    good = judged.filter(F.size("errors") == 0).drop("errors")
    bad = judged.filter(F.size("errors") > 0).withColumn("error", F.array_join("errors", "; ")).drop("errors")
    return insert(df, good), bad


def with_hooks(write: Callable[[DataFrame], DataFrame], rows: DataFrame, before: list[Callable[[DataFrame], DataFrame]] = (), after: list[Callable[[DataFrame], None]] = ()) -> DataFrame:
    """Runs frame-to-frame hooks on the rows, writes, and shows the result to the after hooks."""
    out = write(reduce(lambda r, h: h(r), before, rows))
    for hook in after:
        hook(out)
    return out


def insert_timestamped(df: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """created_at and updated_at in epoch seconds."""
    seconds = F.unix_timestamp(now)
    return insert(df, rows.withColumns({"created_at": seconds, "updated_at": seconds}))


def upsert_timestamped(df: DataFrame, rows: DataFrame, pk: str, now: Column) -> DataFrame:
    """updated_at is now; created_at stays that of an older row of the key."""
    seconds = F.unix_timestamp(now)
    old = df.select(pk, F.col("created_at").alias("__created"))
    new = rows.drop("created_at", "updated_at").join(old, pk, "left").withColumns({"created_at": F.coalesce("__created", seconds), "updated_at": seconds}).drop("__created")
    return upsert(df, new, pk)


def with_next_ids(df: DataFrame, rows: DataFrame, pk: str, order: str) -> DataFrame:
    """``rows`` with ids after the largest one of ``df``, in the given order."""
    from tidemark.operators.query import global_ordinals

    base = df.agg(F.coalesce(F.max(pk), F.lit(0)).alias("__base"))
    numbered = global_ordinals(rows, [F.col(order)], "__n").join(F.broadcast(base))  # one row
    return numbered.withColumn(pk, (F.col("__base") + F.col("__n") + 1).cast("long")).drop("__base", "__n")


# -- expiry --------------------------------------------------------------------------------------------------------


def with_ttl(rows: DataFrame, ttl_ms: Column | int, now_ms: Column | int) -> DataFrame:
    """``rows`` with expires_at in epoch milliseconds."""
    return rows.withColumn("expires_at", (_ms(now_ms) + _ms(ttl_ms)).cast("long"))


def _ms(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def alive(df: DataFrame, now_ms: Column | int) -> DataFrame:
    """Rows without expiry or with a later one; a row expires when now reaches it."""
    return df.filter(F.col("expires_at").isNull() | (F.col("expires_at") > _ms(now_ms)))


def expired(df: DataFrame, now_ms: Column | int) -> DataFrame:
    return df.filter(F.col("expires_at") <= _ms(now_ms))


def remaining(df: DataFrame, now_ms: Column | int) -> DataFrame:
    """``df`` with ttl: milliseconds left, null without expiry."""
    return df.withColumn("ttl", F.greatest(F.col("expires_at") - _ms(now_ms), F.lit(0)))


def expire(df: DataFrame, predicate: Column | str, at_ms: Column | int) -> DataFrame:
    return update_where(df, predicate, expires_at=_ms(at_ms))


def persist(df: DataFrame, predicate: Column | str) -> DataFrame:
    return update_where(df, predicate, expires_at=F.lit(None))


# -- versions ------------------------------------------------------------------------------------------------------


def changes_between(old: DataFrame, new: DataFrame, pk: str) -> DataFrame:
    """(op, key, value): puts of new and changed rows, deletes of gone ones; values as JSON of all columns."""
    value = F.to_json(F.struct(*sorted(c for c in new.columns)))
    a = old.select(F.col(pk).cast("string").alias("key"), value.alias("__a"))
    b = new.select(F.col(pk).cast("string").alias("key"), value.alias("__b"))
    both = a.join(b, "key", "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(F.when(F.col("__b").isNull(), "delete").otherwise("put").alias("op"), "key", F.col("__b").alias("value"))


class Transaction:
    """Staged inserts and deletes with savepoints; the next version is made in one step at commit.

    Reads within see the staged state. Versions are lazy frames, so a savepoint is a reference. ``expected`` refuses the
    commit if the collection has changed meanwhile (by a hash over its rows).
    """

    def __init__(self, df: DataFrame, pk: str):
        self.base, self.now, self.pk = df, df, pk
        self.points: dict[str, DataFrame] = {}

    def insert(self, rows: DataFrame) -> Transaction:
        self.now = upsert(self.now, rows, self.pk)
        return self

    def delete(self, keys: DataFrame) -> Transaction:
        self.now = delete(self.now, self.pk, keys)
        return self

    def savepoint(self, name: str) -> None:
        self.points[name] = self.now

    def rollback_to(self, name: str) -> None:
        self.now = self.points[name]

    def release(self, name: str) -> None:
        del self.points[name]

    def savepoints(self) -> list[str]:
        return list(self.points)

    def rollback(self) -> DataFrame:
        self.now = self.base
        return self.base

    def commit(self, current: DataFrame | None = None) -> DataFrame:
        if current is not None and fingerprint(current) != fingerprint(self.base):
            raise RuntimeError("the collection has changed since the transaction began")
        return self.now


def fingerprint(df: DataFrame) -> tuple:
    """Rows and an order-free hash of them."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0))).first())


def clone_to(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def backup(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").parquet(path)


def compact(df: DataFrame, path: str, files: int) -> None:
    """Rewrites a table into at most ``files`` files."""
    df.repartition(files).write.mode("overwrite").parquet(path)
