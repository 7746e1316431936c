"""The registered queries of the engine's operators, each with SQL that computes the same independently.

Prices have two digits: they are summed as decimals and given as doubles, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import values as V
from tidemark.operators import dml
from tidemark.operators.query import Query, grouped_ordinals
from tidemark.plans import minilang, schemas, sqltext
from tidemark.sources import collections as S
from tidemark.sources.storage import new_folder
from tidemark.streaming import changes as X
from tidemark.streaming import consumers as C
from tidemark.streaming import joins as J
from tidemark.streaming import partitions as P
from tidemark.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "nation": "n_nationkey"}


def query(sql: str | None):
    """Registers a function of (t) under its name; t(name) is a table and t.q(name) its query builder."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def q(self, name: str) -> Query:
        return S.read_collection(self.spark, self.folder, name, KEYS[name])

    def view(self, *names: str) -> SparkSession:
        for name in names:
            self(name).createOrReplaceTempView(name)
        return self.spark


def money(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# -- scans and sources -------------------------------------------------------------------------------------------------


@query("SELECT * FROM customer")
def scan_all(t):
    return t.q("customer").collect()


@query("SELECT * FROM orders WHERE o_orderkey IN (1, 5, 77, 14000)")
def scan_fetch_records(t):
    return S.fetch(t("orders"), "o_orderkey", [5, 1, 77, 14000, 99_999_999])


@query("SELECT * FROM customer WHERE c_custkey = 42")
def scan_get(t):
    return S.get(t("customer"), "c_custkey", 42)


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42")
def scan_exists(t):
    return S.get(t("customer"), "c_custkey", 42).agg((F.count("*") > 0).alias("found"))


@query("SELECT k.c_custkey, pos, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (VALUES (7::BIGINT, 0), (99999999, 1), (3, 2), (7, 3)) k(c_custkey, pos) LEFT JOIN customer c ON c.c_custkey = k.c_custkey")
def scan_get_batch(t):
    return S.get_batch(t("customer"), "c_custkey", [7, 99_999_999, 3, 7]).withColumn("pos", F.col("pos").cast("int"))


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def scan_prefix(t):
    return S.scan_prefix(t("customer"), "c_name", "Customer#00000001")


@query("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def scan_range_half_open(t):
    return S.scan_range(t("orders"), "o_orderkey", 100, 200)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def scan_range_bytes(t):
    keyed = t("orders").withColumn("k", F.encode("o_orderpriority", "UTF-8"))
    return S.scan_range(keyed, "k", b"2", b"4").select("o_orderkey", "o_orderpriority")


LOG = "SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events"


def log_of(t) -> DataFrame:
    return t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


@query(f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ({LOG})) WHERE n = 1 AND op <> 'delete'")
def scan_last_write_wins(t):
    return S.last_write(log_of(t)).select("key", "seq", "value")


@query(f"SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM ({LOG})) WHERE n = 1 AND op <> 'delete' AND key >= 10 AND key < 60")
def scan_last_write_range(t):
    return S.scan_range(S.last_write(log_of(t)).select("key", "seq", "value"), "key", 10, 60)


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 9000")
def scan_changes_since(t):
    return S.changes_since(t("events"), 9000, seq="event_id").select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey AS seq, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey > 14000")
def scan_changes_batches(t):
    batches = t("lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("items"))
    batches = t("orders").select(F.col("o_orderkey").alias("seq")).join(batches, "seq")
    return S.changes_since(batches, 14000, items="items").select("seq", "item.l_linenumber", "item.l_partkey")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id > 5000")
def scan_changes_in_collection(t):
    return S.changes_in(t("events").withColumn("collection", F.col("event_type")), "click", 5000, "event_id").select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE event_id >= 300 ORDER BY event_id LIMIT 50")
def scan_read_from(t):
    return S.read_from(t("events"), 300, 50, "event_id").select("event_id", "value")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer ORDER BY c_custkey LIMIT 10")
def scan_sample_json(t):
    return S.sample_json(t("customer"), "c_custkey", 10).select("key", *[V.json_field("value", c).alias(a) for c, a in (("c_name", "name"), ("c_nationkey", "nation"), ("c_mktsegment", "segment"))])


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS _key, 'customer:' || c_custkey AS _full_key, 'customer' AS _collection FROM customer")
def scan_with_metadata(t):
    return S.enrich_with_key(t("customer").select("c_custkey"), "c_custkey", "customer")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS id FROM customer")
def scan_ensure_id(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 2, F.col("c_name")).alias("id"))
    return S.ensure_id(rows, "c_custkey")


@query("SELECT 'customer' AS collection, CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer WHERE c_custkey IN (1, 2) UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_partkey IN (2, 3)")
def scan_multi_collection(t):
    tables = {"customer": (t("customer"), "c_custkey"), "part": (t("part"), "p_partkey")}
    found = S.multi_get(tables, {"customer": [1, 2], "part": [2, 3]})
    return found.select("collection", "key", F.coalesce(V.json_field("value", "c_name"), V.json_field("value", "p_name")).alias("name"))


@query("SELECT max(event_id) + 1 AS latest FROM events")
def scan_latest_offset(t):
    return S.latest_offset(t("events"), "event_id")


@query("SELECT name FROM (VALUES ('customer'), ('orders'), ('part')) v(name)")
def scan_list_collections(t):
    catalog = S.Catalog(t.spark)
    for name in ("customer", "orders", "part"):
        catalog.create(name, t(name), KEYS[name])
    return catalog.names().filter(F.col("name").isin("customer", "orders", "part"))


@query("SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS BIGINT) AS total")
def scan_total_items(t):
    catalog = S.Catalog(t.spark)
    catalog.create("customer", t("customer"), "c_custkey")
    catalog.create("part", t("part"), "p_partkey")
    return catalog.total_items()


# -- filters and projections -------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def filter_and(t):
    return Query(t("lineitem"), "l_orderkey").filter("l_quantity > 45").filter(F.col("l_discount") < 0.03).collect().select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def filter_find_one(t):
    return t.q("customer").where_eq("c_mktsegment", "BUILDING").first()


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'widget') AND starts_with(p_name, 'red')")
def filter_strings(t):
    return t.q("part").where_contains("p_name", "widget").where_starts_with("p_name", "red").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size > 5 AND p_size < 19 AND p_size <> 12")
def filter_numbers(t):
    return t.q("part").where_gte("p_size", 10).where_lte("p_size", 20).where_gt("p_size", 5).where_lt("p_size", 19).filter("p_size != 12").select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def filter_booleans(t):
    return Query(t("customer").withColumn("debt", F.col("c_acctbal") < 0), "c_custkey").where_is_true("debt").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def filter_is_false(t):
    return Query(t("customer").withColumn("debt", F.col("c_acctbal") < 0), "c_custkey").where_is_false("debt").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE [o_orderstatus, o_orderpriority] = ['F', '1-URGENT']")
def filter_arrays(t):
    rows = t("orders").withColumn("both", F.array("o_orderstatus", "o_orderpriority"))
    return Query(rows, "o_orderkey").where_eq("both", ["F", "1-URGENT"]).pluck("o_orderkey")


@query("SELECT * FROM customer WHERE c_nationkey = 7")
def filter_query_by(t):
    return t.q("customer").where_eq("c_nationkey", 7).collect()


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 18 AND p_size < 30")
def filter_range_half_open(t):
    return t.q("part").where_range("p_size", 18, 30).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 18 AND 30")
def filter_range_closed(t):
    return t.q("part").where_between("p_size", 18, 30).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def filter_prefix(t):
    return t.q("part").where_starts_with("p_brand", "Brand#1").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'")
def filter_compound(t):
    return t.q("orders").where_compound(o_orderstatus="P", o_orderpriority="5-LOW").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0")
def filter_active(t):
    marked = t("customer").withColumn("deleted", F.when(F.col("c_custkey") % 4 == 0, True))
    return Query(marked, "c_custkey").active().select("c_custkey")


@query("SELECT c_custkey, upper(c_name) AS shout, c_acctbal * 2 AS twice FROM customer")
def project_select(t):
    return t.q("customer").select("c_custkey", F.upper("c_name").alias("shout"), (F.col("c_acctbal") * 2).alias("twice"))


@query("SELECT c_mktsegment FROM customer")
def project_pluck(t):
    return t.q("customer").pluck("c_mktsegment")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS kind FROM orders")
def project_computed(t):
    return t.q("orders").with_computed("kind", F.when(F.col("o_totalprice") > 300_000, "large").otherwise("small")).select("o_orderkey", "o_totalprice", "kind")


@query("SELECT o_orderkey, upper(o_orderpriority) AS o_orderpriority FROM orders")
def project_map_computed(t):
    return t.q("orders").map_computed("o_orderpriority", F.upper).select("o_orderkey", "o_orderpriority")


@query("SELECT 'yes' AS side, count(*) AS n FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'no', count(*) FROM orders WHERE NOT (o_totalprice > 250000)")
def filter_partition(t):
    yes, no = t.q("orders").partition("o_totalprice > 250000")
    return yes.agg(F.count("*").alias("n")).withColumn("side", F.lit("yes")).unionByName(no.agg(F.count("*").alias("n")).withColumn("side", F.lit("no")))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '7')")
def minilang_filter(t):
    return minilang.filter_rows(t("customer"), "c_mktsegment=BUILDING,c_name~7").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def minilang_not_equal(t):
    return minilang.filter_rows(t("customer"), "c_mktsegment!=BUILDING,c_nationkey!=7").select("c_custkey")


@query("SELECT event_id FROM events")
def minilang_json_number(t):  # a number is no string, so it differs from every text
    return minilang.filter_json(t("events"), "props", "k!=69").select("event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 30")
def minilang_page(t):
    return minilang.page(t("customer"), "c_custkey", "c_mktsegment!=BUILDING", "c_acctbal:desc", 15, 30)[0].select("c_custkey", "c_acctbal")


@query("SELECT count(*) AS total FROM customer WHERE contains(c_name, '99')")
def minilang_total(t):
    return minilang.page(t("customer"), "c_custkey", "c_name~99")[1]


@query("SELECT c_custkey, k FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS k FROM customer) ORDER BY k ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 1190")
def minilang_sort_missing(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("k"))
    return minilang.page(rows, "c_custkey", "", "k:asc", 20, 1190)[0]


# -- joins -------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, n.n_name FROM customer c LEFT JOIN (SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey) n
ON c.c_nationkey = n.n_regionkey""")
def join_last_wins(t):
    joined = t.q("customer").join_with(t("nation"), "c_nationkey", "n_regionkey", "n_nationkey", "nation")
    return joined.select("c_custkey", F.col("nation.n_name").alias("n_name"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(min(o_orderkey), -1) AS first_order, coalesce(" + SUM.format("o_totalprice") + ", 0.0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_one_to_many_nested(t):
    nested = t.q("customer").collect_with(t("orders"), "o_custkey", "o_orderkey", "orders")
    spent = F.aggregate("orders", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x.o_totalprice.cast("decimal(18,2)")).cast("decimal(28,2)"))
    return nested.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.coalesce(F.get("orders", 0)["o_orderkey"], F.lit(-1)).alias("first_order"), spent.cast("double").alias("spent"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_many_to_one(t):
    return t.q("orders").collect_with_one(t("customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


EV = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = '{}'"


def side(t, kind: str, prefix: str) -> DataFrame:
    rows = t("events").filter(F.col("event_type") == kind)
    return rows.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))


@query(f"SELECT v.user_id, v.event_id AS v_id, p.event_id AS p_id FROM ({EV.format('view')}) v JOIN ({EV.format('purchase')}) p USING (user_id)")
def join_stream_inner(t):
    return J.key_join(side(t, "view", "v"), side(t, "purchase", "p"), "user_id").select("user_id", "v_id", "p_id")


@query(f"SELECT v.user_id, v.event_id AS v_id, p.event_id AS p_id FROM ({EV.format('view')}) v LEFT JOIN ({EV.format('purchase')}) p ON v.user_id = p.user_id")
def join_stream_left(t):
    return J.key_join(side(t, "view", "v"), side(t, "purchase", "p"), "user_id", "left").select("user_id", "v_id", "p_id")


@query(f"SELECT coalesce(v.user_id, p.user_id) AS user_id, v.event_id AS v_id, p.event_id AS p_id FROM ({EV.format('view')}) v FULL JOIN ({EV.format('purchase')}) p ON v.user_id = p.user_id")
def join_stream_outer(t):
    return J.key_join(side(t, "view", "v"), side(t, "purchase", "p"), "user_id", "outer").select("user_id", "v_id", "p_id")


@query(f"SELECT v.user_id, v.event_id AS v_id, p.event_id AS p_id FROM ({EV.format('view')}) v JOIN ({EV.format('purchase')}) p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 6 HOUR")
def join_stream_interval(t):
    return J.interval_join(side(t, "view", "v"), side(t, "purchase", "p"), "user_id", "v_ts", "p_ts", "1 HOUR", "6 HOURS").select("user_id", "v_id", "p_id")


# -- SQL text ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3 AND c_acctbal > 1000.0")
def sql_where_or(t):
    return sqltext.Select("customer", "c_custkey", "c_name").where_eq("c_mktsegment", "BUILDING").or_where_eq("c_nationkey", 3).where_op("c_acctbal", ">", 1000.0).fetch_all(t.view("customer"))


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size <= 9 AND p_type IN ('ECONOMY', 'SMALL')")
def sql_between_in(t):
    return sqltext.Select("part", "p_partkey").where_between("p_size", 5, 9).where_in("p_type", ["ECONOMY", "SMALL"]).fetch_all(t.view("part"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' OR p_name LIKE 'blue%'")
def sql_like(t):
    return sqltext.Select("part", "p_partkey", "p_name").ends_with("p_name", "%ring").where_like("p_name", "blue%", "OR").fetch_all(t.view("part"))


@query("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 400000.0")
def sql_inner_join(t):
    return sqltext.Select("orders o", "o.o_orderkey", "c.c_name").join("customer c", "c.c_custkey = o.o_custkey").where_op("o.o_totalprice", ">", 400000.0).fetch_all(t.view("orders", "customer"))


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
def sql_left_join(t):
    return sqltext.Select("customer c", "c.c_custkey", "o.o_orderkey").left_join("orders o", "o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'").fetch_all(t.view("orders", "customer"))


@query("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000")
def sql_right_join(t):
    return sqltext.Select("orders o", "c.c_custkey", "o.o_orderkey").right_join("customer c", "o.o_custkey = c.c_custkey AND o.o_totalprice > 450000").fetch_all(t.view("orders", "customer"))


@query("SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON r.r_regionkey = n.n_regionkey")
def sql_relations(t):
    return sqltext.select_with_relations("nation", ["nation.n_name", "region.r_name"], [("region", "r_regionkey", "n_regionkey")]).fetch_all(t.view("nation", "region"))


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n INNER JOIN region r ON r.r_regionkey < n.n_regionkey")
def sql_theta_join(t):
    return sqltext.Select("nation n", "n.n_nationkey", "r.r_regionkey").join("region r", "r.r_regionkey < n.n_regionkey").fetch_all(t.view("nation", "region"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 990")
def sql_group_having(t):
    return sqltext.Select("orders", "o_orderpriority", "o_orderstatus", "count(*) AS n").group_by("o_orderpriority", "o_orderstatus").having_op("count(*)", ">=", 990).fetch_all(t.view("orders"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey ASC LIMIT 25 OFFSET 10")
def sql_order_limit_offset(t):
    return sqltext.Select("customer", "c_custkey", "c_acctbal").order_by("c_nationkey").order_by("c_acctbal", "DESC").order_by("c_custkey").limit(25).offset(10).fetch_all(t.view("customer"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 1")
def sql_insert(t):
    return sqltext.Insert("nation", n_nationkey=99, n_name="NOWHERE", n_regionkey=1).apply(t("nation"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 OR c_acctbal < 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def sql_update(t):
    return sqltext.Update("customer", c_mktsegment="VIP").where_eq("c_nationkey", 3).where_op("c_acctbal", "<", 0, "OR").apply(t("customer")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE NOT (c_nationkey = 3 AND c_acctbal < 5000)")
def sql_delete(t):
    return sqltext.Delete("customer").where_eq("c_nationkey", 3).where_op("c_acctbal", "<", 5000).apply(t("customer"), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 5 OFFSET 2)")
def sql_delete_limit(t):
    return sqltext.Delete("customer").where_eq("c_nationkey", 3).limit(5, "c_custkey", 2).apply(t("customer"), "c_custkey").select("c_custkey")


# -- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def agg_count(t):
    return t.q("orders").where_eq("o_orderstatus", "F").count_rows()


@query("SELECT count(DISTINCT o_orderkey) AS count FROM orders")
def agg_count_keys(t):
    return t.q("orders").count_keys()


@query("SELECT count(*) FILTER (o_totalprice > 200000) AS count FROM orders")
def agg_count_where(t):
    return t.q("orders").count_where("o_totalprice > 200000")


@query("SELECT CAST(sum(p_size) AS BIGINT) AS sum FROM part")
def agg_sum(t):
    return t.q("part").sum("p_size")


@query("SELECT CAST(0 AS BIGINT) AS sum")
def agg_sum_empty(t):
    return t.q("part").filter("p_size < 0").sum("p_size")


@query("SELECT avg(p_size) AS avg FROM part")
def agg_avg(t):
    return t.q("part").avg("p_size")


@query("SELECT CAST(0.0 AS DOUBLE) AS avg")
def agg_avg_empty(t):
    return t.q("part").filter("p_size < 0").avg("p_size")


@query("SELECT CAST(NULL AS DOUBLE) AS avg")
def agg_avg_by_empty(t):
    return t.q("part").filter("p_size < 0").avg_by("p_size")


@query("SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def agg_min_max(t):
    q = t.q("orders")
    return q.min("o_totalprice").withColumnRenamed("min", "low").crossJoin(q.max("o_totalprice").withColumnRenamed("max", "high"))  # one row each


@query("SELECT * FROM part ORDER BY p_size, p_partkey LIMIT 1")
def agg_min_by(t):
    return t.q("part").min_by("p_size")


@query("SELECT * FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 1")
def agg_max_by(t):
    return t.q("part").max_by("p_size")


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY 1")
def agg_group_by(t):
    items = t.q("customer").group_by("c_mktsegment")
    return items.select("c_mktsegment", F.size("items").cast("long").alias("n"), F.get("items", 0)["c_custkey"].alias("first_key"), F.element_at("items", -1)["c_custkey"].alias("last_key"))


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sum FROM part GROUP BY 1")
def agg_sum_by(t):
    return t.q("part").sum_by("p_brand", "p_size")


@query("SELECT p_type, count(*) AS count FROM part GROUP BY 1")
def agg_count_by(t):
    return t.q("part").count_by("p_type")


@query("SELECT DISTINCT p_brand FROM part")
def agg_distinct(t):
    return t.q("part").distinct("p_brand")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS b, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n = 1 OR event_type IS DISTINCT FROM b")
def agg_dedup_consecutive(t):
    return t.q("events").dedup_by_key("event_type").select("event_id", "event_type")


@query("SELECT bool_or(p_size > 49) AS any, false AS none FROM part")
def agg_any(t):
    q = t.q("part")
    return q.any("p_size > 49").crossJoin(q.filter("p_size < 0").any("p_size > 0").withColumnRenamed("any", "none"))  # one row each


@query('SELECT bool_and(p_size > 1) AS "all", true AS none FROM part')
def agg_all(t):
    q = t.q("part")
    return q.all("p_size > 1").crossJoin(q.filter("p_size < 0").all("p_size > 0").withColumnRenamed("all", "none"))  # one row each


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id FROM events),
f AS (SELECT user_id, n, (event_id % 1000)::BIGINT AS state FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, (f.state * 31 + e.event_id) % 1000 FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(state, n) AS state FROM f GROUP BY user_id""")
def agg_fold(t):
    return t.q("events").fold(F.lit(0).cast("long"), lambda a, x: (a * 31 + x.event_id) % 1000, "user_id").select("user_id", "state")


@query("SELECT count(*) AS items, CAST(sum(strlen(CAST(n_nationkey AS VARCHAR)) + strlen('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}')) AS BIGINT) AS bytes FROM nation")
def agg_collection_stats(t):
    return S.stats(t("nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT 'c_mktsegment' AS field, count(DISTINCT c_mktsegment) AS unique_values, count(c_mktsegment) AS entries FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(c_nationkey) FROM customer")
def agg_index_stats(t):
    return S.index_stats(t("customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1")
def agg_unique_violations(t):
    return S.unique_violations(t("orders"), "o_custkey")


@query(f"SELECT l_returnflag, l_linestatus, {SUM.format('l_quantity')} AS sum_qty, {SUM.format('l_extendedprice')} AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2")
def agg_flagship(t):
    rows = t("lineitem").filter("l_shipdate <= timestamp_ntz'2001-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))


# -- order and pages ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def page_top_ascending(t):
    return t.q("orders").order_by("o_totalprice").take(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_top_descending(t):
    return t.q("orders").order_by_desc("o_totalprice").skip(40).take(20).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def page_first(t):
    return t.q("part").order_by_desc("p_retailprice").first()


@query("SELECT * FROM part ORDER BY p_size DESC, p_partkey DESC LIMIT 1")
def page_last(t):
    return t.q("part").order_by("p_size").last()


@query("SELECT event_id, value FROM events WHERE event_id < (SELECT coalesce(min(event_id), 1000000000000) FROM events WHERE value > 400)")
def page_take_while(t):
    return t.q("events").take_while("value <= 400").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE event_id >= (SELECT min(event_id) FROM events WHERE value > 400)")
def page_skip_while(t):
    return t.q("events").skip_while("value <= 400").select("event_id", "value")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 10")
def page_after(t):
    return t.q("orders").after(500).order_by("o_orderkey").take(10).select("o_orderkey")


@query("SELECT o_orderkey, true AS has_more FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 25")
def page_keyset(t):
    return t.q("orders").page_after(25, 700).select("o_orderkey", "has_more")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 30 OFFSET 60")
def page_offset_filtered(t):
    return t.q("orders").where_eq("o_orderstatus", "P").page(30, 60).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey > 5 AND o_orderstatus = 'F' AND o_orderkey > 1000 ORDER BY o_orderkey LIMIT 12")
def page_equality_cursor(t):
    return t.q("orders").where_eq("o_orderstatus", "F").filter("o_custkey > 5").page_after(12, 1000).select("o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS ordinal FROM customer")
def page_enumerate(t):
    return t.q("customer").order_by("c_acctbal").numbered().select("c_custkey", "ordinal")


@query("SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS chunk, c_custkey FROM customer")
def page_chunks(t):
    return t.q("customer").chunks(64).select("chunk", F.explode("items").alias("x")).select("chunk", "x.c_custkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '#7'), c_custkey LIMIT 40")
def page_sample(t):
    return t.q("customer").sample(40, 7).select("c_custkey", "c_name")


# -- windows over event time -------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, " + SUM.format("value") + " AS total FROM events GROUP BY 1, 2, 3")
def window_tumbling(t):
    return W.tumbling(t("events"), "ts", "1 hour", F.count("*").alias("n"), money("value").alias("total"), by=["event_type"])


@query("""SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, count(*) AS n, max(value) AS top FROM
(SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 60 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 90 MINUTE]) AS s FROM events) GROUP BY 1, 2""")
def window_sliding(t):
    return W.sliding(t("events"), "ts", "2 hours", "30 minutes", F.count("*").alias("n"), F.max("value").alias("top"))


@query("""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(t):
    return W.session(t("events"), "ts", "4 hours", F.count("*").alias("n"), by=["user_id"])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM events GROUP BY 1")
def window_items(t):
    rows = W.window_items(t("events"), "ts", "1 day", "event_id", ["event_id", "value"])
    return rows.select("window_start", F.get("items", 0)["event_id"].alias("first_id"), F.element_at("items", -1)["event_id"].alias("last_id"), F.size("items").cast("long").alias("n"))


# -- sets --------------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def set_union_distinct(t):
    keys = dml.insert(t("nation").select(F.col("n_nationkey").alias("k")), t("region").select(F.col("r_regionkey").alias("k")))
    return Query(keys, "k").distinct("k")


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT p_partkey FROM part")
def set_union_all(t):
    return dml.insert(t("customer").select(F.col("c_custkey").alias("k")), t("part").select(F.col("p_partkey").alias("k")))


# -- text --------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 1)) AS n FROM documents")
def text_tokenize(t):
    return t("documents").select("doc_id", F.size(T.tokenize("text")).cast("long").alias("n"))


TOKENS = "SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: strlen(x) > 1)) AS token FROM documents"


@query(f"SELECT token, doc_id, count(*) AS tf FROM ({TOKENS}) GROUP BY 1, 2")
def text_index(t):
    return T.text_index(t("documents"), "doc_id", "text")


@query(f"SELECT doc_id, CAST(sum(CASE token WHEN 'the' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM ({TOKENS}) WHERE token IN ('the', 'of') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def text_search(t):
    return T.search_rows(t("documents"), "doc_id", "text", "The of the", 25)


@query(f"SELECT doc_id, CAST(sum(CASE token WHEN 'the' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM ({TOKENS}) WHERE token IN ('the', 'of') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def text_search_stored(t):
    path = new_folder(t.spark, "index")
    T.save_text_index(t("documents"), "doc_id", "text", path)
    return T.search_stored(t.spark, path, "doc_id", "The of the", 25)


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS score FROM ({TOKENS}) WHERE token IN ('and', 'une') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def text_search_tokenized(t):
    return T.search_tokenized(T.text_index(t("documents"), "doc_id", "text"), "doc_id", "and-une!", 25)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def value_json_scalar(t):
    return t("events").select("event_id", V.json_field("props", "k").alias("k"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS k FROM events")
def value_json_decode(t):
    return t("events").select("event_id", (V.decode("props", "k int")["k"] + 1).alias("k"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS naive, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS utc FROM events")
def value_timestamps(t):
    rows = t("events").select("event_id", "ts", F.col("ts").cast("timestamp").alias("at"))
    return rows.select("event_id", V.naive_text("ts").alias("naive"), V.rfc3339_text("at").alias("utc"))


@query("SELECT count(*) AS n, count(DISTINCT (c_mktsegment, c_nationkey)) AS hashes FROM customer")
def value_hash(t):
    rows = t("customer").select(V.value_hash("c_mktsegment", "c_nationkey").alias("h"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("h").alias("hashes"))


# -- writes ------------------------------------------------------------------------------------------------------------


def incoming(t) -> DataFrame:
    return t("customer").filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(1.5)).unionByName(t("customer").filter("c_custkey < 5").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


INCOMING = "SELECT c_custkey, c_name, c_nationkey, 1.5 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 5"


@query(f"SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE), c_mktsegment FROM ({INCOMING})")
def write_insert_batch(t):
    return dml.insert(t("customer"), incoming(t))


@query(f"SELECT * FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DOUBLE), c_mktsegment FROM ({INCOMING})")
def write_upsert(t):
    return dml.upsert(t("customer"), incoming(t), "c_custkey")


@query("SELECT count(*) FILTER (c_custkey % 10 = 0) AS updated, count(*) FILTER (c_custkey < 5) AS inserted FROM customer")
def write_upsert_counts(t):
    return dml.upsert_counts(t("customer"), incoming(t), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey = 9 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def write_update(t):
    return dml.update(t("customer"), "c_custkey", 9, c_acctbal=F.col("c_acctbal") + 1).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def write_update_where(t):
    return dml.update_where(t("customer"), "c_acctbal < 0", c_acctbal=F.lit(0.0)).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")
def write_delete_batch(t):
    keys = t("customer").filter("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete(t("orders"), "o_custkey", keys).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 100)")
def write_delete_where(t):
    return dml.delete_where(t("customer"), "c_acctbal < 100").select("c_custkey")


@query("SELECT c_custkey, c_custkey % 7 = 0 AND c_custkey % 14 <> 0 AS deleted FROM customer")
def write_soft_delete_restore(t):
    rows = t("customer").withColumn("deleted", F.lit(False))
    return dml.restore(dml.soft_delete(rows, "c_custkey % 7 = 0"), "c_custkey % 14 = 0").select("c_custkey", "deleted")


@query("SELECT p_partkey, CASE WHEN p_size < 5 AND p_retailprice > 950 THEN 'p_size: too small; p_retailprice: too dear' WHEN p_size < 5 THEN 'p_size: too small' ELSE 'p_retailprice: too dear' END AS error FROM part WHERE p_size < 5 OR p_retailprice > 950")
def write_validated(t):
    checks = {"p_size": [(F.col("p_size") >= 5, "too small")], "p_retailprice": [(F.col("p_retailprice") <= 950, "too dear")]}
    return dml.insert_validated(t("part").limit(0), t("part"), checks)[1].select("p_partkey", "error")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1000 ELSE 500 END AS updated_at, 500 AS created_at FROM customer UNION ALL SELECT c_custkey + 10000000, 1000, 1000 FROM customer WHERE c_custkey < 5")
def write_timestamped(t):
    first = dml.insert_timestamped(t("customer").limit(0).selectExpr("*", "0L AS created_at", "0L AS updated_at"), t("customer"), F.timestamp_seconds(F.lit(500)))
    second = dml.upsert_timestamped(first, incoming(t), "c_custkey", F.timestamp_seconds(F.lit(1000)))
    return second.select("c_custkey", F.col("updated_at").cast("int").alias("updated_at"), F.col("created_at").cast("int").alias("created_at"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 OR 1000 + c_custkey > 1600")
def write_ttl(t):
    rows = dml.with_ttl(t("customer"), F.col("c_custkey"), 1000)
    return dml.alive(dml.persist(rows, "c_custkey % 3 != 0"), 1600).select("c_custkey")


@query("SELECT c_custkey, greatest(c_custkey - 600, 0) AS ttl FROM customer")
def write_ttl_remaining(t):
    return dml.remaining(dml.with_ttl(t("customer"), F.col("c_custkey"), 1000), 1600).select("c_custkey", "ttl")


@query("SELECT s_suppkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS c_custkey FROM supplier")
def write_next_ids(t):
    return dml.with_next_ids(t("customer"), t("supplier").select("s_suppkey"), "c_custkey", "s_suppkey")


@query("SELECT 'put' AS op, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 10 = 0 AND c_acctbal <> 1.5 OR false UNION ALL SELECT 'put', CAST(c_custkey + 10000000 AS VARCHAR) FROM customer WHERE c_custkey < 5 UNION ALL SELECT 'delete', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 1")
def write_change_rows(t):
    new = dml.delete_where(dml.upsert(t("customer"), incoming(t), "c_custkey"), "c_custkey % 10 = 1 AND c_custkey < 10000000")
    return dml.changes_between(t("customer"), new, "c_custkey").select("op", "key")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 5")
def write_transaction(t):
    tx = dml.Transaction(t("nation"), "n_nationkey").delete(t("nation").filter("n_nationkey < 5"))
    tx.savepoint("a")
    tx.delete(t("nation"))
    tx.rollback_to("a")
    return tx.commit(t("nation")).select("n_nationkey")


@query("SELECT event_id, max(event_id) OVER () + 1 + row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events WHERE event_type = 'click' QUALIFY true")
def log_append_batch(t):
    log = t("events").filter("event_type = 'click'").select("event_id", F.col("event_id").alias("seq"))
    new = t("events").filter("event_type = 'click'").select("event_id")
    return S.append_batch(log, new, ["event_id"]).filter(F.col("seq") > log.agg(F.max("seq")).first()[0])


# -- consumers and changes ---------------------------------------------------------------------------------------------

CLOG = "SELECT 'events' AS collection, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS seq, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events"
OFFS = "SELECT * FROM (VALUES ('g1', 'events', 0, 100), ('g1', 'events', 1, 99999999), ('g2', 'events', 2, 300)) v(\"group\", collection, partition, position)"


def clog(t) -> DataFrame:
    return t("events").select(F.lit("events").alias("collection"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("seq"), "value", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"))


def offs(t) -> DataFrame:
    return t.spark.createDataFrame([("g1", "events", 0, 100), ("g1", "events", 1, 99_999_999), ("g2", "events", 2, 300)], C.OFFSETS)


@query(f"SELECT partition, seq FROM (SELECT l.*, row_number() OVER (PARTITION BY l.partition ORDER BY seq) AS n FROM ({CLOG}) l LEFT JOIN (SELECT * FROM ({OFFS}) WHERE \"group\" = 'g1') o ON o.partition = l.partition WHERE seq >= coalesce(position, 0) AND op <> 'delete') WHERE n <= 50")
def consumer_poll(t):
    log = clog(t)
    return C.poll(log, C.starting_positions(log, offs(t), "g1"), 50).select("partition", "seq")


@query(f"SELECT partition, CAST(max(seq) + 1 AS BIGINT) AS position FROM (SELECT l.*, row_number() OVER (PARTITION BY partition ORDER BY seq) AS n FROM ({CLOG}) l WHERE op <> 'delete') WHERE n <= 50 GROUP BY 1")
def consumer_commit(t):
    log = clog(t)
    after = C.advanced(log, C.starting_positions(log, offs(t).limit(0), "g9"), 50)
    return C.group_offsets(C.commit(offs(t), "g9", after), "g9").select("partition", "position")


@query(f"SELECT DISTINCT partition, CAST(max(seq) OVER (PARTITION BY partition) + 1 AS BIGINT) AS position FROM ({CLOG})")
def consumer_latest(t):
    return C.starting_positions(clog(t), offs(t).limit(0), "g9", C.LATEST).select("partition", "position")


@query(f"SELECT partition, seq FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY seq) AS n FROM ({CLOG}) WHERE seq >= 77 AND op <> 'delete') WHERE n <= 5")
def consumer_seek_position(t):
    log = clog(t)
    return C.poll(log, C.seek(C.starting_positions(log, offs(t), "g1"), 77), 5).select("partition", "seq")


@query(f"SELECT min(CASE partition WHEN 0 THEN 100 WHEN 1 THEN 99999999 ELSE 0 END)::BIGINT AS position FROM ({CLOG}) WHERE partition < 2")
def consumer_position(t):
    at = C.starting_positions(clog(t), offs(t), "g1").filter("partition < 2")
    return C.position(at)


@query(f"SELECT * FROM ({OFFS}) WHERE \"group\" <> 'g1'")
def consumer_delete_group(t):
    return C.delete_group(offs(t), "g1")


@query(f"SELECT \"group\", collection, partition, position FROM ({OFFS}) WHERE \"group\" = 'g2' UNION ALL SELECT 'g1', 'events', partition, max(seq) + 1 FROM ({CLOG}) GROUP BY partition")
def consumer_close(t):
    log = clog(t)
    return C.close(offs(t), "g1", C.starting_positions(log, offs(t).limit(0), "g1", C.LATEST))


@query(f"SELECT o.\"group\", o.partition, m AS latest, CAST(position AS BIGINT) AS committed, CAST(greatest(m - position, 0) AS BIGINT) AS lag FROM ({OFFS}) o JOIN (SELECT partition, max(seq) + 1 AS m FROM ({CLOG}) GROUP BY 1) USING (partition)")
def consumer_lag(t):
    return C.lag(clog(t), offs(t)).select("group", "partition", "latest", "committed", "lag")


@query(f"SELECT \"group\", partition, CAST(CASE WHEN \"group\" = 'g1' THEN m ELSE position END AS BIGINT) AS position FROM ({OFFS}) JOIN (SELECT partition, max(seq) + 1 AS m FROM ({CLOG}) GROUP BY 1) USING (partition)")
def consumer_reset(t):
    return C.reset_offsets(offs(t), clog(t), "g1").select("group", "partition", "position")


@query('SELECT * FROM (VALUES (\'g1\'), (\'g2\')) v("group")')
def consumer_groups(t):
    return C.groups(offs(t))


@query("SELECT * FROM (VALUES (0, 100), (2, 0)) v(partition, position)")
def consumer_reassign(t):
    positions = C.starting_positions(clog(t), offs(t), "g1").filter("partition in (0, 1)")
    new = t.spark.createDataFrame([("events", 0), ("events", 2)], "collection string, partition int")
    return C.reassigned(positions, new, offs(t), "g1").select("partition", F.col("position").cast("int").alias("position"))


@query("SELECT * FROM (VALUES ('c1', 0), ('c1', 3), ('c1', 6), ('c2', 1), ('c2', 4), ('c2', 7), ('c3', 2), ('c3', 5), ('c3', 8)) v(consumer, partition)")
def assign_round_robin(t):
    return P.assignment_rows(t.spark, P.round_robin(9, ["c1", "c2", "c3"]))


@query("SELECT 'c1' AS consumer, CAST(unnest(range(5)) AS INTEGER) AS partition UNION ALL SELECT 'c2', CAST(unnest(range(5, 10)) AS INTEGER)")
def assign_range(t):
    return P.assignment_rows(t.spark, P.contiguous(10, ["c1", "c2"]))


PREVIOUS = "SELECT * FROM (VALUES ('c1', 0), ('c1', 1), ('c1', 2), ('c2', 3), ('c2', 4), ('gone', 5), ('gone', 6), ('gone', 7)) v(consumer, partition)"


@query(f"SELECT consumer, partition FROM ({PREVIOUS}) WHERE consumer <> 'gone' UNION ALL SELECT ['c1', 'c2', 'c3'][(row_number() OVER (ORDER BY partition) - 1) % 3 + 1], partition FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS partition) WHERE partition NOT IN (SELECT partition FROM ({PREVIOUS}) WHERE consumer <> 'gone')")
def assign_sticky(t):
    previous = {"c1": [0, 1, 2], "c2": [3, 4], "gone": [5, 6, 7]}
    return P.assignment_rows(t.spark, P.rebalance(10, ["c1", "c2", "c3"], "sticky", 1, previous)[0])


@query("SELECT * FROM (VALUES ('a', 0, 3), ('a', 2, 3), ('b', 1, 3), ('b', 3, 3)) v(consumer, partition, generation)")
def assign_group(t):  # two join, a third joins and leaves again
    group = P.Group(4, "round_robin")
    for member in ("a", "b"):
        group.join(member)
    group.join("a")
    group.join("c"), group.leave("c")
    return P.assignment_rows(t.spark, group.assigned).withColumn("generation", F.lit(group.generation - 1))


@query("SELECT true AS joined, false AS same")
def assign_needs_rebalancing(t):
    return t.spark.createDataFrame([(P.needs_rebalancing({"a": [0]}, ["a", "b"]), P.needs_rebalancing({"a": [0], "b": [1]}, ["b", "a"]))], "joined boolean, same boolean")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 5000 THEN 1 ELSE 2 END AS INTEGER) AS partition FROM orders")
def partition_ranges(t):
    return t("orders").select("o_orderkey", P.Ranges([5000, 100]).column(F.col("o_orderkey")).cast("int").alias("partition"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 3 AS INTEGER) AS partition, (row_number() OVER (ORDER BY event_id) - 1) // 3 AS seq FROM events")
def partition_append_round_robin(t):
    return P.append_partitioned(t("events").select("event_id"), 3, "event_id").select("event_id", "partition", "seq")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, count(DISTINCT user_id) AS owners FROM events")
def partition_by_key(t):  # each key has one partition
    rows = P.with_partition(t("events"), "user_id", 8)
    return rows.filter("partition between 0 and 7").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("keys"), F.countDistinct("user_id", "partition").alias("owners"))


HASHED = "('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT"


@query(f"SELECT event_id, CAST({HASHED} % 8 AS INTEGER) AS partition FROM events")
def partition_custom(t):
    return P.with_partition(t("events"), "user_id", 8, P.md5_partition).select("event_id", "partition")


@query(f"WITH r AS (SELECT n, ('0x' || substr(md5(n || '#' || k), 1, 8))::BIGINT AS p FROM (SELECT unnest(['n1', 'n2', 'n3']) AS n) CROSS JOIN (SELECT unnest(range(16)) AS k)), u AS (SELECT DISTINCT user_id, {HASHED} AS h FROM events) SELECT user_id, coalesce((SELECT arg_min(n, p) FROM r WHERE p >= h), (SELECT arg_min(n, p) FROM r)) AS node FROM u")
def partition_ring(t):
    return Query(t("events"), "event_id").distinct("user_id").withColumn("node", P.Ring(["n1", "n2", "n3"]).node(F.col("user_id")))


@query("SELECT partition, count(*) AS rows, min(seq) AS first, max(seq) AS last FROM (SELECT CAST(user_id % 4 AS INTEGER) AS partition, event_id AS seq FROM events) GROUP BY 1")
def partition_stats(t):
    return P.partition_stats(clog(t))


@query("WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, CAST(ceil(count(*) OVER () / 4) AS BIGINT) AS size FROM events) SELECT event_id, CAST(n // size AS INTEGER) AS partition, n % size AS seq FROM e")
def partition_append_chunks(t):
    return P.append_partitioned(t("events").select("event_id"), 4, "event_id", chunks=True)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events")
def partition_places(t):
    return grouped_ordinals(t("events"), "user_id", [F.col("event_id").asc()], "place").select("event_id", "place")


@query("SELECT * FROM (VALUES ('start', '10,20'), ('split', '10,15,20'), ('merged', '15,20'), ('within', '0,1')) v(step, boundaries)")
def partition_split_merge(t):
    start = P.Ranges([20, 10])
    split = start.split(15)
    text = lambda x: ",".join(map(str, x))
    return t.spark.createDataFrame([("start", text(start.boundaries)), ("split", text(split.boundaries)), ("merged", text(split.merge(10).boundaries)), ("within", text(split.within(3, 15)))], "step string, boundaries string")


@query(f"SELECT user_id, {SUM.format('value')} AS total FROM events GROUP BY 1")
def change_replay(t):
    return X.replay(t("events").withColumn("value", F.col("value").cast("decimal(18,2)")), "user_id", "value").withColumn("total", F.col("total").cast("double"))


@query(f"SELECT user_id, {SUM.format('value')} AS total FROM events GROUP BY 1")
def change_snapshot_resume(t):
    log = t("events").select(F.col("event_id").alias("seq"), "user_id", F.col("value").cast("decimal(18,2)").alias("value"))
    snapshot, rest = X.snapshot_and_compact(log, 4000, "user_id", "value")
    return X.resume(snapshot, rest, "user_id", "value").withColumn("total", F.col("total").cast("double"))


@query("SELECT event_id FROM events WHERE epoch_ms(ts) >= 1705000000000")
def change_drain_since(t):
    rows = t("events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return X.drain_since(rows, 1_705_000_000_000, "ms").select("event_id")


@query("SELECT event_id FROM events WHERE event_id > 2500")
def change_compact(t):
    return X.compact_log(t("events"), 2500, "event_id").select("event_id")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20 OR (n <= 150 AND epoch_ms(ts) >= 1706000000000 - 100000000)")
def change_retention(t):
    rows = t("events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    policy = X.RetentionPolicy(max_age_ms=100_000_000, max_count=150, min_keep=20)
    return policy.apply(rows, "event_type", "ms", "event_id", 1_706_000_000_000).select("event_id", "event_type")


@query("SELECT user_id AS key, event_id AS seq FROM events WHERE starts_with(CAST(user_id AS VARCHAR), '1') AND event_id > 8000")
def change_watch(t):
    rows = t("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"))
    return X.watch(rows, "1", 8000).select(F.col("key").cast("long").alias("key"), "seq")


OUTCOME = "CASE WHEN value < 20 THEN 'ok' WHEN value < 50 THEN 'retry' ELSE 'dlq' END"


@query(f"SELECT p AS processed, r AS retries, d AS dlq_sent, CAST(0 AS BIGINT) AS dropped, p / n AS success_rate FROM (SELECT count(*) FILTER (o = 'ok') AS p, count(*) FILTER (o = 'retry') AS r, count(*) FILTER (o = 'dlq' OR (o = 'retry' AND k + 1 >= 3)) AS d, count(*) AS n FROM (SELECT {OUTCOME} AS o, event_id % 3 AS k FROM events))")
def dlq_stats(t):
    rows = t("events").withColumn("retries", (F.col("event_id") % 3).cast("int"))
    return X.processing_stats(rows, F.expr(OUTCOME), 3)


@query(f"SELECT event_id, CASE WHEN {OUTCOME} = 'dlq' THEN 'sent to the dead letters' ELSE 'retries are spent' END AS error FROM events WHERE {OUTCOME} = 'dlq' OR ({OUTCOME} = 'retry' AND event_id % 3 = 2)")
def dlq_process(t):
    rows = t("events").withColumn("retries", (F.col("event_id") % 3).cast("int"))
    return X.process(rows, F.expr(OUTCOME), 3)[2].select("event_id", "error")


@query("SELECT event_id, CAST(CASE WHEN event_id % 4 + 1 < 3 THEN event_id % 4 + 1 ELSE event_id % 4 END AS INTEGER) AS attempts FROM events WHERE NOT (value < 30)")
def dlq_drain(t):
    rows = t("events").withColumn("attempts", (F.col("event_id") % 4).cast("int"))
    return X.drain_dead_letters(rows, F.col("value") < 30, 3)[1].select("event_id", "attempts")


# -- schemas -----------------------------------------------------------------------------------------------------------


@query("SELECT 'k' AS field, 'integer' AS type, count(*) AS entries FROM events")
def schema_analyze_json(t):
    return schemas.analyze_json(t("events"), "props")


def _analyzed(*fields: tuple[str, str]) -> str:
    one = "SELECT '{0}' AS field, '{1}' AS type, count(*) - count({0}) AS nulls, count(DISTINCT {0}) AS distinct_values, count(*) = count(DISTINCT {0}) AS is_key, min(CAST({0} AS VARCHAR)) AS least FROM customer"
    return " UNION ALL ".join(one.format(*f) for f in fields)


@query(_analyzed(("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")))
def schema_analyze(t):
    found = schemas.analyze(t("customer").drop("c_acctbal"), exact=True)
    return found.withColumn("least", F.col("samples")[0]).drop("samples")


@query("SELECT * FROM (VALUES ('added', 'c_phone', false), ('removed', 'c_name', true), ('type', 'c_nationkey', true)) v(kind, field, breaking)")
def schema_compare(t):
    old = t("customer").schema
    new = t("customer").drop("c_name").withColumns({"c_nationkey": F.col("c_nationkey").cast("long"), "c_phone": F.lit("")}).schema
    return t.spark.createDataFrame([(c.kind, c.field, c.breaking) for c in schemas.compare(old, new)], "kind string, field string, breaking boolean")


@query("SELECT * FROM (VALUES ('first', 1), ('again', 1), ('wider', 2), ('refused', 0), ('migrated', 3), ('latest', 3)) v(step, version)")
def schema_registry(t):
    known, base = schemas.SchemaRegistry(), t("nation")
    narrow = base.drop("n_name")
    steps = [("first", known.register("nation", base.schema)), ("again", known.register("nation", base.schema)), ("wider", known.register("nation", base.withColumn("x", F.lit(1)).schema))]
    try:
        steps.append(("refused", known.register("nation", narrow.schema)))
    except ValueError:
        steps.append(("refused", 0))
    steps += [("migrated", known.register("nation", narrow.schema, "m1")), ("latest", known.latest_version("nation"))]
    return t.spark.createDataFrame(steps, "step string, version int")


@query("SELECT 'customer' AS name, 2 AS fields, 'bigint' AS kind")
def schema_get(t):
    known = schemas.SchemaRegistry()
    known.register("customer", t("customer").select("c_custkey", "c_name").schema)
    found = known.get("customer", 1)
    return t.spark.createDataFrame([(n, len(found), found[0].dataType.simpleString()) for n in known.names()], "name string, fields int, kind string")


@query("SELECT 'CREATE TABLE IF NOT EXISTS customer (c_custkey BIGINT NOT NULL, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING) USING parquet' AS ddl")
def schema_ddl(t):
    return t.spark.createDataFrame([(sqltext.create_table_sql("customer", t("customer").schema, "c_custkey"),)], "ddl string")


@query("SELECT count(*) AS rows, 5 AS fields, count(DISTINCT c_custkey) AS keys, true AS key_is_unique FROM customer")
def schema_describe(t):
    return schemas.describe(t("customer"), "c_custkey")


@query("SELECT n_nationkey, upper(n_name) AS title, n_nationkey % 2 = 0 AS premium FROM nation")
def schema_migrate(t):
    steps = {2: lambda d: d.withColumn("premium", F.col("n_nationkey") % 2 == 0), 3: lambda d: d.select("n_nationkey", F.upper("n_name").alias("title"), "premium")}
    return schemas.migrate(t("nation"), 1, 3, steps)


# -- copies, snapshots and saved indexes -------------------------------------------------------------------------------


def kept(t, write: Callable[[str], None]) -> DataFrame:
    """What ``write`` puts into a new folder, read again."""
    path = new_folder(t.spark, "copy")
    write(path)
    return t.spark.read.parquet(path)


@query("SELECT * FROM supplier")
def write_clone(t):
    return kept(t, lambda path: dml.clone_to(t("supplier"), path))


@query("SELECT * FROM part")
def write_backup(t):
    return kept(t, lambda path: dml.backup(t("part"), path))


@query("SELECT count(*) AS rows, true AS few FROM orders")
def write_compact(t):
    found = kept(t, lambda path: dml.compact(t("orders").repartition(9), path, 2)).select(F.input_file_name().alias("file"))
    return found.agg(F.count("*").alias("rows"), (F.countDistinct("file") <= 2).alias("few"))


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation")
def write_with_hooks(t):
    upper = lambda rows: rows.withColumn("n_name", F.upper("n_name"))
    shift = lambda rows: rows.withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast(rows.schema["n_nationkey"].dataType))
    seen = []
    out = dml.with_hooks(lambda rows: dml.insert(upper(t("nation")), rows), t("nation"), [upper, shift], [seen.append])
    return seen[0].select(*out.columns)


@query("SELECT * FROM nation WHERE n_regionkey <> 1")
def write_delete_with_hooks(t):
    return dml.with_hooks(lambda keys: dml.delete(t("nation"), "n_nationkey", keys), t("nation"), [lambda rows: rows.filter("n_regionkey = 1")])


@query("SELECT event_id FROM events WHERE event_id + 1000 <= 5000")
def write_ttl_cleanup(t):
    return dml.expired(dml.with_ttl(t("events"), 1000, F.col("event_id")), 5000).select("event_id")


@query("SELECT * FROM region")
def scan_snapshot(t):
    return S.snapshot(t("region"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def scan_partitioned(t):
    path = new_folder(t.spark, "parts")
    S.write_partitioned(t("orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return S.read_partition(t.spark, path, o_orderstatus="F")


@query("SELECT * FROM customer WHERE c_name = 'Customer#000000007'")
def filter_query_unique(t):
    return S.query_unique(t("customer"), "c_name", "Customer#000000007")


@query("SELECT p_partkey AS key FROM part WHERE p_size = 7")
def scan_saved_index(t):
    path = new_folder(t.spark, "index")
    S.save_index(t("part"), "p_partkey", "p_size", path)
    return S.load_index(t.spark, path, 7)


@query("SELECT true AS pushed, true AS pruned")
def page_explain(t):
    plan = Query(t("lineitem").select("l_orderkey", "l_quantity"), "l_orderkey").where_gt("l_quantity", 45).explain()
    return t.spark.createDataFrame([("GreaterThan(l_quantity" in plan, "l_comment" not in plan and "l_discount" not in plan)], "pushed boolean, pruned boolean")


@query("SELECT s_suppkey AS c_custkey FROM supplier WHERE s_suppkey >= 5 ORDER BY 1 LIMIT 3")
def page_preloaded(t):
    return t.q("customer").where_gte("c_custkey", 5).take(3).preloaded(t("supplier").filter("s_suppkey >= 5").select(F.col("s_suppkey").alias("c_custkey"))).collect()


# -- streams -----------------------------------------------------------------------------------------------------------


def streamed(t, sink: Callable[[DataFrame, int], None], change: Callable[[DataFrame], DataFrame] = lambda rows: rows, files: int = 2) -> None:
    """Runs the events through a stream of at most ``files`` files a batch until all are handled."""
    folder = new_folder(t.spark, "events")
    t("events").repartition(5).write.parquet(folder)
    stream = X.event_stream(t.spark, folder, "*.parquet", t("events").schema, files)
    query = X.run_pipeline(change(stream), sink, new_folder(t.spark, "checkpoint"))
    query.awaitTermination()


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 50")
def stream_filter_map(t):
    path = new_folder(t.spark, "sink")
    change = lambda rows: rows.filter("value > 50").select("event_id", F.upper("event_type").alias("kind"))
    streamed(t, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"), change)
    return t.spark.read.parquet(path).drop("batch")


def put(t) -> tuple[DataFrame, DataFrame]:
    """Table and change rows that a stream of events leaves; errors are deletes."""
    table, changes = new_folder(t.spark, "table"), new_folder(t.spark, "changes")
    streamed(t, X.write_with_changes(table, changes, "event_id", "event_id", F.col("event_type") == "error"))
    return t.spark.read.parquet(table).drop("batch"), t.spark.read.parquet(changes).drop("batch")


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'")
def stream_put(t):
    return put(t)[0].select("event_id", "user_id", "value")


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events")
def stream_outbox(t):
    return put(t)[1].select("key", "seq", "op", F.get_json_object("value", "$.user_id").cast("long").alias("user_id"))


@query("SELECT op, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events) GROUP BY 1")
def stream_handlers(t):
    rows = X.change_rows(t("events"), "event_id", "event_id", F.col("event_type") == "error")
    count = lambda part: part.groupBy("op").agg(F.count("*").alias("n"))
    return X.handled(rows, {"put": count, "delete": count})


@query("SELECT event_id FROM events WHERE event_id >= 500")
def stream_outbox_drain(t):
    return X.drain_since(t("events"), 500, "event_id").select("event_id")


@query("SELECT user_id, count(*) AS total FROM events GROUP BY 1")
def change_saved_state(t):
    path = new_folder(t.spark, "state")
    log = t("events").select("user_id", F.col("event_id").alias("seq"), F.lit(1).alias("n"))
    rest = log
    for upto in (100, 4000):  # the later run replaces the earlier one
        rest = X.snapshot_job(log, path, upto, "user_id", "n")
    state, _ = X.load_state(t.spark, path)
    return X.resume(state, rest, "user_id", "n")
