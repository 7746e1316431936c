"""The query builder on small fixtures: order, ties, nulls and empty inputs."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.query import Query, global_ordinals

PEOPLE = [("a", 30, "Ann", None), ("b", 18, "Bob", 2.0), ("c", 30, "Cid", 1.0), ("d", None, "Dan", 5.0), ("e", 18, "Eve", 4.0)]


@pytest.fixture(scope="module")
def people(spark):
    return Query(spark.createDataFrame(PEOPLE, "id string, age long, name string, pay double"), "id")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_is_stable_and_last_order_wins(people):
    assert ids(people.order_by("name").order_by("age").collect()) == ["d", "b", "e", "a", "c"]
    assert ids(people.order_by_desc("age").take(3).collect()) == ["a", "c", "b"]
    assert ids(people.order_by_desc("age").skip(1).take(2).collect()) == ["c", "b"]


def test_first_and_last(people):
    assert ids(people.order_by("age").filter("age is not null").first()) == ["b"]
    assert ids(people.order_by("age").last()) == ["c"]
    assert ids(people.order_by_desc("age").last()) == ["d"]
    assert ids(people.order_by("age").take(3).last()) == ["e"]
    assert people.filter("false").last().count() == 0


def test_extremes_take_first_and_last_of_ties(people):
    assert ids(people.min_by("age")) == ["b"] and ids(people.max_by("age")) == ["c"]
    assert people.filter("age is null").min_by("age").count() == 0


def test_empty_aggregates(people):
    none = people.filter("false")
    assert none.sum("age").first()[0] == 0 and none.avg("age").first()[0] == 0.0 and none.avg_by("age").first()[0] is None
    assert none.min("age").first()[0] is None and none.any("age > 1").first()[0] is False and none.all("age > 1").first()[0] is True
    assert none.count_rows().first()[0] == 0


def test_while(people):
    assert ids(people.take_while("age >= 18").orderBy("id")) == ["a", "b", "c"]
    assert ids(people.skip_while("age >= 18").orderBy("id")) == ["d", "e"]
    assert ids(people.take_while("true").orderBy("id")) == list("abcde") and people.skip_while("true").count() == 0


def test_consecutive_duplicates_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "a")], "id int, k string")
    assert sorted(ids(Query(rows, "id").dedup_by_key("k"))) == [1, 3, 5]


def test_partition_keeps_unknown_on_the_other_side(people):
    yes, no = people.partition("age > 20")
    assert sorted(ids(yes)) == ["a", "c"] and sorted(ids(no)) == ["b", "d", "e"]


def test_pages(people):
    page, cursor = people.paginate(2)
    assert ids(page) == ["a", "b"] and cursor == "b"
    page, cursor = people.paginate(2, "d")
    assert ids(page) == ["e"] and cursor is None
    page, cursor = people.paginate(2, "e")
    assert ids(page) == [] and cursor is None
    with pytest.raises(ValueError):
        people.order_by("age").paginate(2)


def test_chunks(people):
    rows = {r["chunk"]: [x["id"] for x in r["items"]] for r in people.chunks(2).collect()}
    assert rows == {0: ["a", "b"], 1: ["c", "d"], 2: ["e"]}


def test_sample_repeats(people):
    assert ids(people.sample(3, 1)) == ids(people.sample(3, 1)) and people.sample(99).count() == 5


def test_joins(spark, people):
    orders = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (3, "b", 7.0)], "o int, who string, total double")
    last = people.join_with(orders, "id", "who", "o").orderBy("id").collect()
    assert [r["related"]["o"] if r["related"] else None for r in last] == [2, 3, None, None, None]
    many = people.collect_with(orders, "who", "o").orderBy("id").collect()
    assert [[x["o"] for x in r["related"]] for r in many] == [[1, 2], [3], [], [], []]
    one = Query(orders, "o").collect_with_one(people.df, "who", "id")
    assert sorted((r["o"], r["name"]) for r in one.collect()) == [(1, "Ann"), (2, "Ann"), (3, "Bob")]


def test_fold_goes_in_key_order(spark):
    rows = spark.createDataFrame([("x", k, str(k)) for k in range(20)], "g string, id int, s string").repartition(5)
    assert Query(rows, "id").fold(F.lit(""), lambda a, x: F.concat(a, x.s), "g").first()["state"] == "".join(map(str, range(20)))


def test_explain_shows_pushed_filters(spark, data):
    text = Query(spark.read.parquet(f"{data}/lineitem.parquet"), "l_orderkey").filter("l_quantity > 45").explain()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), max_size=40))
def test_ordinals_are_dense(spark, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v int").repartition(4)
    got = {r["id"]: r["ordinal"] for r in global_ordinals(rows, [F.col("v"), F.col("id")]).collect()}
    want = {k: n for n, (_, k) in enumerate(sorted((v, k) for k, v in enumerate(values)))}
    assert got == want


def test_last_by_an_expression_and_borders(spark):
    rows = Query(spark.createDataFrame([(1, 5, None), (2, 1, "x"), (3, 9, "x"), (4, None, "y"), (5, 2, "y")], "id long, a long, k string"), "id")
    assert [r["id"] for r in rows.order_by(F.col("a") + F.col("id")).last().collect()] == [3]
    assert [r["id"] for r in rows.order_by_desc(F.col("a") + F.col("id")).last().collect()] == [4]
    for block in (1, 2, 100):
        assert sorted(r["id"] for r in rows.dedup_by_key("k", block).collect()) == [1, 2, 4]
    down = rows.order_by_desc("a")  # 3, 1, 5, 2, 4
    assert sorted(r["id"] for r in down.take_while("a > 2").collect()) == [1, 3] and sorted(r["id"] for r in down.skip_while("a > 2").collect()) == [2, 4, 5]
    assert sorted(r["id"] for r in down.take_while("a is not null").collect()) == [1, 2, 3, 5] and rows.order_by("a").take_while("a is not null").count() == 0
