from tidemark.llm.skew import spread_join


def test_a_hot_key_is_spread_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(900)] + [(1000, None), (1001, "none")], "id long, key string")
    facts = rows.filter("key != 'none'").groupBy("key").count().selectExpr("key", "`count` as n", "upper(key) as fact")
    found = spread_join(rows, facts, ["key"], ["id"], least=50)
    assert sorted(found.columns) == ["fact", "id", "key"]
    assert {r["id"]: r["fact"] for r in found.collect()} == {r["id"]: None if r["key"] in (None, "none") else r["key"].upper() for r in rows.collect()}
    assert found.count() == 902
    assert spread_join(rows.limit(0), facts.limit(0), ["key"], ["id"]).collect() == []
