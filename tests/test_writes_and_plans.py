import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidemark.functions import text as T
from tidemark.functions import values as V
from tidemark.operators import dml
from tidemark.plans import minilang, schemas, sqltext
from tidemark.sources import collections as S


@pytest.fixture
def users(spark):
    return spark.createDataFrame([(1, "Ann", 10.0), (2, "Bob", None), (3, None, 30.0)], "id long, name string, pay double")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_last_of_repeats_wins(spark, users):
    new = spark.createDataFrame([(2, "X", 1.0), (2, "Y", 2.0), (9, "Z", 0.0)], "id long, name string, pay double")
    assert rows(dml.upsert(users, new, "id", "pay")) == [(1, "Ann", 10.0), (2, "Y", 2.0), (3, None, 30.0), (9, "Z", 0.0)]


def test_unknown_predicates_do_not_match(users):
    assert rows(dml.delete_where(users, "pay > 5")) == [(2, "Bob", None)]
    assert rows(dml.update_where(users, "pay > 5", name=F.lit("R"))) == [(1, "R", 10.0), (2, "Bob", None), (3, "R", 30.0)]


def test_validation(users):
    good, bad = dml.insert_validated(users.limit(0), users, {"name": [(F.col("name").isNotNull(), "missing")], "pay": [(F.col("pay") > 20, "too low")]})
    assert rows(good) == []
    assert sorted((r["id"], r["error"]) for r in bad.collect()) == [(1, "pay: too low"), (2, "pay: too low"), (3, "name: missing")]


def test_hooks(users):
    seen = []
    out = dml.with_hooks(lambda r: dml.insert(users, r), users.limit(1), [lambda r: r.withColumn("id", F.col("id") + 100)], [lambda r: seen.append(r.count())])
    assert out.count() == 4 and seen == [4]


def test_transactions(spark, users):
    tx = dml.Transaction(users, "id")
    tx.insert(spark.createDataFrame([(4, "D", 1.0)], users.schema))
    tx.savepoint("s")
    tx.delete(users.select("id"))
    assert tx.now.count() == 1 and tx.savepoints() == ["s"]
    tx.rollback_to("s")
    assert tx.commit(users).count() == 4
    with pytest.raises(RuntimeError):
        tx.commit(users.limit(1))
    assert tx.rollback().count() == 3


def test_expiry_is_at_the_instant(users):
    held = dml.with_ttl(users, 100, 1000)
    assert dml.alive(held, 1099).count() == 3 and dml.alive(held, 1100).count() == 0 and dml.expired(held, 1100).count() == 3
    assert dml.alive(dml.persist(held, "id = 1"), 5000).count() == 1
    assert dml.alive(dml.expire(held, "id = 1", 1), 1050).count() == 2


def test_copies(spark, users, tmp_path):
    dml.clone_to(users, str(tmp_path / "a"))
    dml.backup(users, str(tmp_path / "b"))
    dml.compact(spark.read.parquet(str(tmp_path / "a")), str(tmp_path / "c"), 1)
    assert all(rows(spark.read.parquet(str(tmp_path / x))) == rows(users) for x in "abc")


def test_last_write(spark):
    log = spark.createDataFrame([("k", 1, "put", "a"), ("k", 2, "delete", None), ("m", 3, "put", "b"), ("m", 4, "put", "c"), ("n", 5, "delete", None), ("n", 6, "put", "d")], "key string, seq long, op string, v string")
    assert rows(S.last_write(log).select("key", "v")) == [("m", "c"), ("n", "d")]


def test_get_batch_keeps_places(users):
    assert [(r["pos"], r["name"]) for r in S.get_batch(users, "id", [3, 9, 1, 1]).collect()] == [(0, None), (1, None), (2, "Ann"), (3, "Ann")]
    assert S.exists(users, "id", 1) and not S.exists(users, "id", 5)


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "Rust async-rust é a dév x2 ß")], "id long, t string")
    assert df.select(T.tokenize("t")).first()[0] == ["rust", "async", "rust", "é", "dév", "x2", "ß"]
    index = T.text_index(df, "id", "t")
    assert T.search(index, "id", "Rust rust dév zz").first()["score"] == 5
    assert T.search(index, "id", " ").count() == 0


def test_minilang(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 6), (3, "xy", 5)], "id long, s string, n int")
    ids = lambda where: sorted(r["id"] for r in minilang.filter_rows(df, where).collect())
    assert ids("s=x") == [1] and ids("s!=x") == [2, 3] and ids("s~x") == [1, 3]
    assert ids("n=5") == [] and ids("n!=5") == [1, 2, 3] and ids("gone!=1") == [1, 2, 3] and ids("gone=1") == []
    assert ids("s~x, s!=x") == [3] and ids("") == [1, 2, 3]
    with pytest.raises(ValueError):
        minilang.parse("abc")
    order = lambda sort: [r["id"] for r in minilang.page(df, "id", "", sort)[0].collect()]
    assert order("s:asc") == [1, 3, 2] and order("s:desc") == [2, 3, 1] and order("n:desc") == [2, 1, 3] and order("gone") == [1, 2, 3]


def test_json_strings(spark):
    df = spark.createDataFrame([(1, '{"k": "7"}'), (2, '{"k": 7}'), (3, "{}"), (4, "bad"), (5, None)], "id long, j string")
    assert sorted(r["id"] for r in minilang.filter_json(df, "j", "k=7").collect()) == [1]
    assert sorted(r["id"] for r in minilang.filter_json(df, "j", "k!=7").collect()) == [2, 3, 4, 5]
    assert [r[0] for r in df.orderBy("id").select(V.json_field("j", "k")).collect()] == ["7", "7", None, None, None]


def test_sql_text():
    text, args = sqltext.Select("t", "a").where_in("c", [1, 2]).where_eq("a", 1).or_where_eq("b", 2).limit(3).build()
    assert text == "SELECT a FROM t WHERE a = ? OR b = ? AND c IN (?, ?) LIMIT 3" and args == [1, 2, 1, 2]
    assert sqltext.Insert("t", a=1, b="x").build() == ("INSERT INTO t (a, b) VALUES (?, ?)", [1, "x"])
    assert sqltext.Update("t", a=1).where_eq("b", 2).build() == ("UPDATE t SET a = ? WHERE b = ?", [1, 2])
    assert sqltext.Delete("t").build() == ("DELETE FROM t", [])
    with pytest.raises(ValueError):
        sqltext.Select("t").where_op("a", "; drop", 1)


def test_sql_fetch(spark, users):
    users.createOrReplaceTempView("users_t")
    q = sqltext.Select("users_t", "id").where_eq("name", "Ann")
    assert q.fetch_one(spark)["id"] == 1
    assert sqltext.Select("users_t").where_in("id", []).fetch_optional(spark) is None
    with pytest.raises(LookupError):
        sqltext.Select("users_t").where_eq("id", 99).fetch_one(spark)


def test_ddl():
    schema = StructType([StructField("id", LongType()), StructField("s", StringType()), StructField("d", DoubleType())])
    assert sqltext.create_table_sql("t", schema, "id") == "CREATE TABLE IF NOT EXISTS t (id BIGINT NOT NULL, s STRING, d DOUBLE) USING parquet"


def test_schema_registry():
    one = StructType([StructField("id", LongType()), StructField("s", StringType())])
    two = StructType([*one, StructField("x", DoubleType())])
    three = StructType([StructField("id", StringType())])
    reg = schemas.SchemaRegistry()
    assert reg.register("t", one) == 1 and reg.register("t", one) == 1 and reg.register("t", two) == 2
    with pytest.raises(ValueError):
        reg.register("t", three)
    assert reg.register("t", three, "m1") == 3 and reg.get("t", 1) == one and reg.get("t") == three and reg.names() == ["t"] and reg.latest_version("t") == 3
    assert {(c.field, c.kind, c.breaking) for c in schemas.compare(two, three)} == {("s", "removed", True), ("x", "removed", True), ("id", "type", True)}
    assert not any(c.breaking for c in schemas.compare(two, three, schemas.FORWARD)) and schemas.compare(two, three, schemas.NONE) == []
