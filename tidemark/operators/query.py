"""The fluent query builder: a lazy DataFrame with a primary key and an order.

Every method returns a new builder or a DataFrame; predicates, keys and projections are ``Column`` expressions, so Spark
sees all of them. Where the order of rows matters, ties are broken by the primary key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Predicate = Column | str


def _column(c: Predicate) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Query:
    df: DataFrame
    pk: str
    keys: tuple[tuple[Column, bool], ...] = ()  # expression, whether it descends
    start: int = 0
    count: int | None = None

    # -- building ------------------------------------------------------------------------------------------------

    def filter(self, predicate: Predicate) -> Query:
        """Rows for which the predicate is true (not null); several calls are ANDed."""
        return replace(self, df=self.df.filter(_column(predicate)))

    def where_eq(self, field: str, value) -> Query:
        return self.filter(F.col(field) == F.lit(value))

    def where_gt(self, field: str, value) -> Query:
        return self.filter(F.col(field) > F.lit(value))

    def where_lt(self, field: str, value) -> Query:
        return self.filter(F.col(field) < F.lit(value))

    def where_gte(self, field: str, value) -> Query:
        return self.filter(F.col(field) >= F.lit(value))

    def where_lte(self, field: str, value) -> Query:
        return self.filter(F.col(field) <= F.lit(value))

    def where_contains(self, field: str, value: str) -> Query:
        return self.filter(F.col(field).contains(value))

    def where_starts_with(self, field: str, value: str) -> Query:
        return self.filter(F.col(field).startswith(value))

    def where_is_true(self, field: str) -> Query:
        return self.filter(F.col(field))

    def where_is_false(self, field: str) -> Query:
        return self.filter(~F.col(field))

    def where_compound(self, **values) -> Query:
        """Equality on several fields at once."""
        out = self
        for field, value in values.items():
            out = out.where_eq(field, value)
        return out

    def where_range(self, field: str, low, high) -> Query:
        """Half open: low <= field < high, by the field's type."""
        return self.filter((F.col(field) >= F.lit(low)) & (F.col(field) < F.lit(high)))

    def where_between(self, field: str, low, high) -> Query:
        """Closed: low <= field <= high."""
        return self.filter(F.col(field).between(F.lit(low), F.lit(high)))

    def active(self, deleted: str = "deleted") -> Query:
        """Rows that are not soft-deleted; a null mark is not deleted."""
        return self.filter(~F.coalesce(F.col(deleted), F.lit(False)))

    def order_by(self, key: Predicate) -> Query:
        """Ascending; a later order replaces an earlier one."""
        return replace(self, keys=((F.col(key) if isinstance(key, str) else key, False),))

    def order_by_desc(self, key: Predicate) -> Query:
        return replace(self, keys=((F.col(key) if isinstance(key, str) else key, True),))

    def take(self, n: int) -> Query:
        return replace(self, count=n)

    def skip(self, n: int) -> Query:
        return replace(self, start=n)

    def after(self, cursor) -> Query:
        """Keyset cursor: rows whose key is greater."""
        return self.filter(F.col(self.pk) > F.lit(cursor))

    def preloaded(self, df: DataFrame) -> Query:
        """The same query over other rows."""
        return replace(self, df=df)

    # -- rows ----------------------------------------------------------------------------------------------------

    @property
    def order(self) -> list[Column]:
        return [*[k.desc() if down else k.asc() for k, down in self.keys], F.col(self.pk).asc()]

    def collect(self) -> DataFrame:
        """The rows, ordered if an order, offset or limit was asked for."""
        if not self.keys and not self.start and self.count is None:
            return self.df
        df = self.df.orderBy(*self.order)
        if self.start:
            df = df.offset(self.start)
        return df if self.count is None else df.limit(self.count)

    def first(self) -> DataFrame:
        return replace(self, count=1).collect()

    def last(self) -> DataFrame:
        """The last row after ordering, offset and limit."""
        if self.start or self.count is not None:
            ordered = self.collect()
            place = F.row_number().over(Window.orderBy(*self.order))
            return ordered.withColumn("__n", place).orderBy(F.desc("__n")).limit(1).drop("__n")  # a page, not the table
        return self.df.orderBy(*[k.asc_nulls_first() if down else k.desc_nulls_last() for k, down in self.keys], F.col(self.pk).desc()).limit(1)

    def select(self, *columns) -> DataFrame:
        return self.collect().select(*columns)

    def pluck(self, field: str) -> DataFrame:
        return self.collect().select(field)

    def with_computed(self, name: str, value: Column) -> DataFrame:
        return self.collect().withColumn(name, value)

    def map_computed(self, name: str, change: Callable[[Column], Column]) -> DataFrame:
        return self.collect().withColumn(name, change(F.col(name)))

    def partition(self, predicate: Predicate) -> tuple[DataFrame, DataFrame]:
        """Rows that match, and all others (null counts as no match)."""
        match = F.coalesce(_column(predicate), F.lit(False))
        rows = self.collect()
        return rows.filter(match), rows.filter(~match)

    def numbered(self, name: str = "ordinal", partition: str | None = None) -> DataFrame:
        """0-based ordinal in the query's order.

        Over a whole collection the ordinals come from a range shuffle: places within each range plus the sizes of the
        ranges before it, so no task gets all rows. With ``partition`` they count within each of its values.
        """
        rows = self.collect()
        if partition is not None:
            return rows.withColumn(name, (F.row_number().over(Window.partitionBy(partition).orderBy(*self.order)) - 1).cast("long"))
        return global_ordinals(rows, self.order, name)

    def chunks(self, n: int) -> DataFrame:
        """(chunk, items): runs of ``n`` rows, items in order; the last may be shorter."""
        rows = self.numbered("__n")
        item = F.struct("__n", *self.df.columns)
        chunk = rows.groupBy(F.floor(F.col("__n") / n).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        return chunk.select("chunk", F.transform("items", lambda x: x.dropFields("__n")).alias("items"))

    def take_while(self, predicate: Predicate) -> DataFrame:
        """The rows before the first that does not match."""
        return self._while(predicate, True)

    def skip_while(self, predicate: Predicate) -> DataFrame:
        """The first row that does not match and all after it."""
        return self._while(predicate, False)

    def _while(self, predicate: Predicate, before: bool) -> DataFrame:
        """A filter against the first row that does not match: one top-1 and one scan, no sort of all rows."""
        rows = self.collect()
        parts = [*self.keys, (F.col(self.pk), False)]
        marked = rows.withColumn("__own", F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(parts)]))
        failing = marked.filter(~F.coalesce(_column(predicate), F.lit(False))).orderBy(*self.order).limit(1)
        stop = failing.agg(F.first("__own").alias("__stop"))
        is_before, same = F.lit(False), F.lit(True)
        for i, (_, down) in enumerate(parts):
            own, end = F.col(f"__own.k{i}"), F.col(f"__stop.k{i}")
            # ascending keys begin with nulls, descending ones end with them
            earlier = F.coalesce(own > end, F.lit(False)) | (own.isNotNull() & end.isNull()) if down else F.coalesce(own < end, F.lit(False)) | (own.isNull() & end.isNotNull())
            is_before, same = is_before | (same & earlier), same & own.eqNullSafe(end)
        kept = F.col("__stop").isNull() | is_before
        return marked.join(F.broadcast(stop)).filter(kept if before else ~kept).select(*rows.columns)  # one row

    def dedup_by_key(self, key: str, block: int = 100_000) -> DataFrame:
        """Drops consecutive rows with the same key (nulls are equal).

        Rows are dealt by blocks of their ordinals; the last row of a block is copied to the next one.
        """
        rows = self.numbered("__n")
        own = F.floor(F.col("__n") / block).cast("long")
        places = F.when((F.col("__n") + 1) % block == 0, F.array(F.struct(own.alias("b"), F.lit(False).alias("x")), F.struct((own + 1).alias("b"), F.lit(True).alias("x")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("x"))))
        dealt = rows.withColumn("__at", F.explode(places)).withColumns({"__b": F.col("__at.b"), "__copy": F.col("__at.x")})
        by = Window.partitionBy("__b").orderBy("__n")
        marked = dealt.withColumns({"__before": F.lag(key).over(by), "__has": F.lag(F.lit(True)).over(by)})
        return marked.filter(~F.col("__copy") & (F.col("__has").isNull() | ~F.col(key).eqNullSafe(F.col("__before")))).select(*self.df.columns)

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """``n`` rows by a hash of the key and the seed: the same rows each time."""
        return self.df.orderBy(F.md5(F.concat_ws("#", F.col(self.pk).cast("string"), F.lit(str(seed)))), self.pk).limit(n)

    def explain(self) -> str:
        return self.collect()._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # -- pages ---------------------------------------------------------------------------------------------------

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        return replace(self, start=offset, count=limit).collect()

    def page_after(self, limit: int, cursor=None) -> DataFrame:
        """Keyset page in key order with has_more; other orders are refused, as a cursor on the key is unsound there."""
        if self.keys:
            raise ValueError("a keyset page is ordered by the primary key")
        base = self if cursor is None else self.after(cursor)
        found = base.df.orderBy(self.pk).limit(limit + 1)
        place = F.row_number().over(Window.orderBy(self.pk))  # limit + 1 rows
        more = F.count("*").over(Window.partitionBy()) > limit
        return found.withColumn("__n", place).withColumn("has_more", more).filter(F.col("__n") <= limit).drop("__n")

    def paginate(self, limit: int, cursor=None) -> tuple[DataFrame, object]:
        """(page, next cursor or None)."""
        page = self.page_after(limit, cursor)
        last = page.select(F.max(self.pk), F.max("has_more")).first()
        return page.drop("has_more"), last[0] if last[1] else None

    # -- aggregates ----------------------------------------------------------------------------------------------

    def count_rows(self) -> DataFrame:
        return self.collect().agg(F.count("*").alias("count"))

    def count_keys(self) -> DataFrame:
        return self.collect().agg(F.countDistinct(self.pk).alias("count"))

    def count_where(self, predicate: Predicate) -> DataFrame:
        return self.collect().agg(F.count_if(_column(predicate)).alias("count"))

    def sum(self, field: str) -> DataFrame:
        """0 for no rows."""
        return self.collect().agg(F.coalesce(F.sum(field), F.lit(0)).alias("sum"))

    def avg(self, field: str) -> DataFrame:
        """0.0 for no rows."""
        return self.collect().agg(F.coalesce(F.avg(field), F.lit(0.0)).alias("avg"))

    def avg_by(self, field: str) -> DataFrame:
        """Null for no rows."""
        return self.collect().agg(F.avg(field).alias("avg"))

    def min(self, field: str) -> DataFrame:
        return self.collect().agg(F.min(field).alias("min"))

    def max(self, field: str) -> DataFrame:
        return self.collect().agg(F.max(field).alias("max"))

    def min_by(self, key: Predicate) -> DataFrame:
        """The row with the smallest key, the first on a tie."""
        return self._extreme(key, F.min_by)

    def max_by(self, key: Predicate) -> DataFrame:
        """The row with the largest key, the last on a tie."""
        return self._extreme(key, F.max_by)

    def _extreme(self, key: Predicate, pick) -> DataFrame:
        key = F.col(key) if isinstance(key, str) else key
        rows = self.collect().filter(key.isNotNull())
        best = rows.agg(pick(F.struct(*self.df.columns), F.struct(key.alias("k"), F.col(self.pk).alias("pk"))).alias("r"))
        return best.filter("r is not null").select("r.*")

    def group_by(self, key: str) -> DataFrame:
        """(key, items): rows of each key, by primary key."""
        item = F.struct(self.pk, *[c for c in self.df.columns if c != self.pk])
        return self.collect().groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def sum_by(self, key: str, field: str) -> DataFrame:
        return self.collect().groupBy(key).agg(F.sum(field).alias("sum"))

    def count_by(self, key: str) -> DataFrame:
        return self.collect().groupBy(key).agg(F.count("*").alias("count"))

    def distinct(self, key: str) -> DataFrame:
        return self.collect().select(key).distinct()

    def any(self, predicate: Predicate) -> DataFrame:
        """False for no rows."""
        return self.collect().agg(F.coalesce(F.bool_or(F.coalesce(_column(predicate), F.lit(False))), F.lit(False)).alias("any"))

    def all(self, predicate: Predicate) -> DataFrame:
        """True for no rows."""
        return self.collect().agg(F.coalesce(F.bool_and(F.coalesce(_column(predicate), F.lit(False))), F.lit(True)).alias("all"))

    def fold(self, initial: Column, step: Callable[[Column, Column], Column], key: str) -> DataFrame:
        """(key, state): a left fold over the rows of each key in key order."""
        item = F.struct(self.pk, *[c for c in self.df.columns if c != self.pk])
        rows = self.collect().groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
        return rows.select(key, F.aggregate("items", initial, step).alias("state"))

    # -- joins ---------------------------------------------------------------------------------------------------

    def join_with(self, right: DataFrame, on: str, right_key: str, order: str, alias: str = "related") -> DataFrame:
        """N:1 left outer join; of right rows with one key the last by ``order`` wins, nested as ``alias``."""
        item = F.struct(*right.columns)
        single = right.groupBy(F.col(right_key).alias("__k")).agg(F.max_by(item, F.col(order)).alias(alias))
        return self.collect().join(single, F.col(on) == F.col("__k"), "left").drop("__k")

    def collect_with(self, right: DataFrame, foreign_key: str, order: str, alias: str = "related") -> DataFrame:
        """1:N left outer join: the right rows of each key as a list by ``order``, empty if there are none."""
        item = F.struct(order, *[c for c in right.columns if c != order])
        many = right.groupBy(F.col(foreign_key).alias("__k")).agg(F.array_sort(F.collect_list(item)).alias(alias))
        joined = self.collect().join(many, F.col(self.pk) == F.col("__k"), "left").drop("__k")
        return joined.withColumn(alias, F.coalesce(alias, F.array()))

    def collect_with_one(self, right: DataFrame, foreign_key: str, right_key: str) -> DataFrame:
        """N:1 left outer join on the related row's key, columns side by side."""
        return self.collect().join(right, F.col(foreign_key) == F.col(right_key), "left")


def global_ordinals(rows: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """0-based places in a total order, without gathering the rows in one task."""
    from tidemark.sources.storage import settled

    # The ranges are fixed by writing them: both readers below must see the same ones.
    dealt = settled(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__c"))  # a row per range
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn(name, own).join(F.broadcast(before), "__p").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__p", "__before")


def grouped_ordinals(rows: DataFrame, group: str, order: list[Column], name: str = "ordinal") -> DataFrame:
    """0-based places within each group, without gathering a group in one task: global places less the group's first."""
    numbered = global_ordinals(rows, [F.col(group).asc(), *order], "__g")
    first = numbered.groupBy(group).agg(F.min("__g").alias("__first"))  # a row per group
    return numbered.join(first.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__g") - F.col("__first")).drop("__g", "__first", "__group")
