"""Scans, point reads and prefix and range reads of collections and of key-value and log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.operators.query import Query


def read_collection(spark: SparkSession, folder: str, name: str, pk: str) -> Query:
    """All rows of a collection stored as Parquet."""
    return Query(spark.read.parquet(f"{folder}/{name}.parquet"), pk)


def snapshot(df: DataFrame) -> DataFrame:
    """The rows as they are now, written: later changes of the source do not show."""
    from tidemark.sources.storage import settled

    return settled(df)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    """A table with a folder per value of ``columns``; a filter on them reads only the folders it needs."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def read_partition(spark: SparkSession, path: str, **values) -> DataFrame:
    """Rows of the folders with these values (pruned by the planner)."""
    df = spark.read.parquet(path)
    for column, value in values.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


class Catalog:
    """Collections by name, with their primary keys; names are temporary views."""

    def __init__(self, spark: SparkSession):
        self.spark, self.keys = spark, {}

    def create(self, name: str, df: DataFrame, pk: str) -> Query:
        df.createOrReplaceTempView(name)
        self.keys[name] = pk
        return Query(df, pk)

    def drop(self, name: str) -> bool:
        self.keys.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def get(self, name: str) -> Query:
        return Query(self.spark.table(name), self.keys[name])

    def names(self) -> DataFrame:
        """Registered names and those of the session's tables, each once."""
        found = {*self.keys, *(t.name for t in self.spark.catalog.listTables())}
        return self.spark.createDataFrame([(n,) for n in sorted(found)], "name string")

    def total_items(self) -> DataFrame:
        out = None
        for name in sorted(self.keys):
            one = self.spark.table(name).agg(F.count("*").alias("n"))
            out = one if out is None else out.unionByName(one)
        return out.agg(F.sum("n").alias("total")) if out is not None else self.spark.createDataFrame([(0,)], "total long")


def _keys(df: DataFrame, pk: str, ids: Sequence) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], StructType([StructField("pos", df.sparkSession.range(0).schema[0].dataType), StructField(pk, df.schema[pk].dataType)]))


def get(df: DataFrame, pk: str, value) -> DataFrame:
    return df.filter(F.col(pk) == F.lit(value))


def exists(df: DataFrame, pk: str, value) -> bool:
    return not get(df, pk, value).isEmpty()


def fetch(df: DataFrame, pk: str, ids: Sequence) -> DataFrame:
    """The rows of the given ids; missing ids are left out."""
    return df.join(_keys(df, pk, ids).select(pk).distinct(), pk, "left_semi")


def get_batch(df: DataFrame, pk: str, ids: Sequence) -> DataFrame:
    """A row per given id in its place (pos), with nulls where it is missing."""
    return _keys(df, pk, ids).join(df, pk, "left").orderBy("pos")


def multi_get(tables: dict[str, tuple[DataFrame, str]], wanted: dict[str, Sequence]) -> DataFrame:
    """(collection, key, value): lookups in several collections, values as JSON."""
    out = None
    for name in sorted(wanted):
        df, pk = tables[name]
        one = fetch(df, pk, wanted[name]).select(F.lit(name).alias("collection"), F.col(pk).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def scan_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.filter(F.col(key).startswith(prefix))


def scan_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Half open by the key's type; binary keys compare as bytes."""
    return df.filter((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def sample_json(df: DataFrame, pk: str, n: int) -> DataFrame:
    """(key, value): the first ``n`` rows by key, as JSON."""
    return df.orderBy(pk).limit(n).select(F.col(pk).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def stats(df: DataFrame, key: str) -> DataFrame:
    """Items and bytes (key and JSON value)."""
    size = F.octet_length(F.col(key).cast("string")) + F.octet_length(F.to_json(F.struct("*")))
    return df.agg(F.count("*").alias("items"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def index_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, unique_values, entries) in one pass over the rows."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    rows = df.select(F.explode(F.array(*parts)).alias("x")).filter("x.value is not null")
    return rows.groupBy("x.field").agg(F.countDistinct("x.value").alias("unique_values"), F.count("*").alias("entries"))


def query_unique(df: DataFrame, field: str, value) -> DataFrame:
    """The row whose field has the value, or none; an error if several have it."""
    found = df.filter(F.col(field) == F.lit(value)).limit(2)
    one = found.agg(F.count("*").alias("__n"), F.first(F.struct(*df.columns)).alias("r"))
    row = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{field} is not unique")).cast(one.schema["r"].dataType)).otherwise(F.col("r"))
    return one.filter("__n > 0").select(row.alias("r")).select("r.*")


def save_index(df: DataFrame, pk: str, field: str, path: str) -> None:
    """The index of a field, (value, key) sorted by value in each file, so that row groups are skipped."""
    df.select(F.col(field).alias("value"), F.col(pk).alias("key")).filter("value is not null").repartitionByRange("value").sortWithinPartitions("value").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, value) -> DataFrame:
    """(key) of the rows with a value, from a saved index."""
    return spark.read.parquet(path).filter(F.col("value") == F.lit(value)).select("key")


def unique_violations(df: DataFrame, field: str) -> DataFrame:
    """(field's value, count) of values that more than one row holds."""
    return df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("count")).filter("count > 1")


# -- logs of puts and deletes ------------------------------------------------------------------------------------------


def last_write(log: DataFrame, key: str = "key", seq: str = "seq", op: str = "op", columns: Sequence[str] | None = None) -> DataFrame:
    """The latest row of each key, without keys whose latest row is a delete. Partial aggregation, so no key is gathered."""
    row = F.struct(*log.columns)
    latest = log.groupBy(F.col(key).alias("__k")).agg(F.max_by(row, F.col(seq)).alias("r")).select("r.*")
    latest = latest.filter(F.col(op) != "delete")
    return latest.select(*columns) if columns else latest


def changes_since(log: DataFrame, offset: int, seq: str = "seq", items: str | None = None) -> DataFrame:
    """Rows beyond an offset; a batch column is expanded, its items share the offset."""
    rows = log.filter(F.col(seq) > F.lit(offset))
    return rows if items is None else rows.withColumn("item", F.explode(items)).drop(items)


def changes_in(log: DataFrame, collection: str, offset: int, seq: str = "seq") -> DataFrame:
    return log.filter((F.col("collection") == collection) & (F.col(seq) > F.lit(offset)))


def read_from(log: DataFrame, offset: int, most: int, seq: str = "seq") -> DataFrame:
    """At most ``most`` rows from an offset on (included)."""
    return log.filter(F.col(seq) >= F.lit(offset)).orderBy(seq).limit(most)


def append_batch(log: DataFrame, rows: DataFrame, order: list[Column | str], seq: str = "seq") -> DataFrame:
    """``log`` with ``rows`` numbered on from its last offset."""
    from tidemark.operators.query import global_ordinals

    base = log.agg(F.coalesce(F.max(seq) + 1, F.lit(0)).alias("__base"))
    numbered = global_ordinals(rows, [F.col(o) if isinstance(o, str) else o for o in order], seq).join(F.broadcast(base))
    return log.unionByName(numbered.withColumn(seq, F.col(seq) + F.col("__base")).drop("__base"), allowMissingColumns=True)


def latest_offset(log: DataFrame, seq: str = "seq") -> DataFrame:
    return log.agg(F.coalesce(F.max(seq) + 1, F.lit(0)).cast("long").alias("latest"))


def enrich_with_key(df: DataFrame, pk: str, collection: str) -> DataFrame:
    """Rows with _key, _full_key and _collection."""
    key = F.col(pk).cast("string")
    return df.withColumns({"_key": key, "_full_key": F.concat(F.lit(collection + ":"), key), "_collection": F.lit(collection)})


def ensure_id(df: DataFrame, key: str, field: str = "id") -> DataFrame:
    """``field`` filled from the key where it is missing, null or empty."""
    old = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
    return df.withColumn(field, F.coalesce(F.nullif(old, F.lit("")), F.col(key).cast("string")))

