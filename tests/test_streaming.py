import pytest
from pyspark.sql import functions as F

from tidemark.streaming import changes as X
from tidemark.streaming import consumers as C
from tidemark.streaming import joins as J
from tidemark.streaming import partitions as P
from tidemark.streaming import windows as W


def test_assignments():
    assert P.round_robin(9, ["c3", "c1", "c2"]) == {"c1": [0, 3, 6], "c2": [1, 4, 7], "c3": [2, 5, 8]}
    assert P.contiguous(10, ["c1", "c2"]) == {"c1": list(range(5)), "c2": list(range(5, 10))}
    assert P.contiguous(5, ["a", "b", "c"]) == {"a": [0, 1], "b": [2, 3], "c": [4]}
    assert P.sticky(4, ["a", "b"], {"a": [0, 1, 2]}) == {"a": [0, 1, 2, 3], "b": []}
    assert P.round_robin(3, []) == {} and P.contiguous(3, []) == {} and P.sticky(3, [], {}) == {}
    assert P.needs_rebalancing({"a": [0]}, ["a", "b"]) and not P.needs_rebalancing({"a": [0]}, ["a"])
    assert P.rebalance(2, ["a"], "range", 4) == ({"a": [0, 1]}, 5)


def test_ranges():
    r = P.Ranges([10, 20])
    assert [r.partition(k) for k in (9, 10, 19, 20, 99)] == [0, 1, 1, 2, 2]
    assert r.within(5, 10) == [0] and r.within(5, 11) == [0, 1] and r.within(15, 30) == [1, 2]
    assert r.split(15).boundaries == [10, 15, 20] and r.merge(10).boundaries == [20]


LOG = [("t", 0, 0, "put"), ("t", 0, 1, "delete"), ("t", 0, 2, "put"), ("t", 0, 3, "put"), ("t", 1, 4, "delete"), ("t", 1, 5, "delete")]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, "collection string, partition int, seq long, op string")


def test_consumers(spark, log):
    offsets = spark.createDataFrame([], C.OFFSETS)
    at = C.starting_positions(log, offsets, "g")
    assert sorted(r["seq"] for r in C.poll(log, at, 2).collect()) == [0, 2]
    at = C.advanced(log, at, 2)
    assert {r["partition"]: r["position"] for r in at.collect()} == {0: 3, 1: 6}  # only deletes: still moves on
    offsets = C.commit(offsets, "g", at)
    assert sorted(r["seq"] for r in C.poll(log, C.starting_positions(log, offsets, "g"), 9).collect()) == [3]
    assert {r["partition"]: r["lag"] for r in C.lag(log, offsets).collect()} == {0: 1, 1: 0}
    assert {r["partition"]: r["position"] for r in C.starting_positions(log, offsets, "h", C.LATEST).collect()} == {0: 4, 1: 6}
    with pytest.raises(Exception, match="no committed offset"):
        C.starting_positions(log, offsets, "h", C.NONE).collect()
    assert C.starting_positions(log, offsets, "g", C.NONE).count() == 2
    assert {r["position"] for r in C.reset_offsets(offsets, log, "g", 0).collect()} == {0}
    assert C.delete_group(offsets, "g").count() == 0 and C.position(at).first()[0] == 3


def test_dead_letters(spark):
    rows = spark.createDataFrame([(1, "ok", 0), (2, "retry", 0), (3, "retry", 2), (4, "dlq", 0)], "id int, o string, retries int")
    ok, again, dead = X.process(rows, F.col("o"), 3)
    assert [r["id"] for r in ok.collect()] == [1] and [(r["id"], r["retries"]) for r in again.collect()] == [(2, 1)] and sorted(r["id"] for r in dead.collect()) == [3, 4]
    assert tuple(X.processing_stats(rows, F.col("o"), 3).first()) == (1, 2, 2, 0, 0.25)
    assert tuple(X.processing_stats(rows, F.col("o"), 3, False).first()) == (1, 2, 0, 2, 0.25)
    assert X.processing_stats(rows.limit(0), F.col("o"), 3).first()["success_rate"] == 1.0
    letters = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "id int, attempts int")
    done, left = X.drain_dead_letters(letters, F.col("id") == 1, 3)
    assert done.count() == 1 and sorted((r["id"], r["attempts"]) for r in left.collect()) == [(2, 2), (3, 2)]


def test_retention(spark):
    rows = spark.createDataFrame([("a", k, k * 100) for k in range(10)] + [("b", 50, 0)], "topic string, seq long, ms long")
    keep = lambda p: sorted(r["seq"] for r in p.apply(rows, "topic", "ms", "seq", 1000).collect())
    assert keep(X.RetentionPolicy(max_age_ms=300)) == [7, 8, 9]
    assert keep(X.RetentionPolicy(max_age_ms=300, min_keep=5)) == [5, 6, 7, 8, 9, 50]
    assert keep(X.RetentionPolicy(max_count=2)) == [8, 9, 50]
    assert keep(X.RetentionPolicy(max_count=2, batch=3)) == [3, 4, 5, 6, 7, 8, 9, 50]
    assert len(keep(X.RetentionPolicy())) == 11


def test_replay_twice_gives_the_same(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], k) for k in range(10)], "seq long, key string, d long")
    once = sorted(map(tuple, X.replay(rows, "key", "d").collect()))
    state, rest = X.snapshot_and_compact(rows, 4, "key", "d")
    assert once == [("a", 20), ("b", 25)] == sorted(map(tuple, X.resume(state, rest, "key", "d").collect()))
    joined = X.replay_fold(rows, "key", "seq", F.lit(""), lambda a, x: F.concat(a, x.d.cast("string")), ["d"])
    assert sorted(map(tuple, joined.collect())) == [("a", "02468"), ("b", "13579")]


def source(spark, tmp_path, data):
    path = str(tmp_path / "in")
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(path)
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_state_equals_batch(spark, tmp_path, data):
    events, stream = source(spark, tmp_path, data)
    q = X.running_totals(stream, "user_id", "value").writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["user_id"]: (round(r["total"], 6), r["events"]) for r in spark.table("totals").collect()}
    want = {r["user_id"]: (round(r["total"], 6), r["events"]) for r in X.running_totals(events, "user_id", "value").collect()}
    assert got == want


def test_streamed_windows_with_late_events(spark, tmp_path, data):
    events, stream = source(spark, tmp_path, data)
    frame = W.tumbling(W.event_time(stream, "ts", "40 days"), "ts", "1 day", F.count("*").alias("n"))
    q = frame.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["window_start"]: r["n"] for r in spark.table("days").collect()}
    assert got == {r["window_start"]: r["n"] for r in W.tumbling(events, "ts", "1 day", F.count("*").alias("n")).collect()}


def test_streamed_interval_join(spark, tmp_path, data):
    events, stream = source(spark, tmp_path, data)
    side = lambda df, kind, p: df.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"))
    join = lambda a, b: J.interval_join(a, b, "user_id", "v_ts", "p_ts", "1 HOUR", "6 HOURS").select("v_id", "p_id")
    live = join(side(stream, "view", "v").withWatermark("v_ts", "40 days"), side(stream, "purchase", "p").withWatermark("p_ts", "40 days"))
    q = live.writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert sorted(map(tuple, spark.table("pairs").collect())) == sorted(map(tuple, join(side(events, "view", "v"), side(events, "purchase", "p")).collect()))


def test_pipeline_retries_and_restarts(spark, tmp_path, data):
    events, stream = source(spark, tmp_path, data)
    sink = X.write_with_changes(str(tmp_path / "t"), str(tmp_path / "x"), "event_id", "event_id")
    failures = [2]

    def flaky(rows, batch):
        if failures[0]:
            failures[0] -= 1
            raise OSError("not yet")
        sink(rows, batch)

    for _ in range(2):  # the second run finds nothing new
        X.run_pipeline(stream, flaky, str(tmp_path / "c"), backoff_s=0.01).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == events.count() == spark.read.parquet(str(tmp_path / "x")).count()


def test_streamed_dedup(spark, tmp_path, data):
    _, stream = source(spark, tmp_path, data)
    twice = stream.unionByName(stream)
    q = X.deduplicated(twice, ["event_id"], "ts", "40 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("once")
    assert rows.count() == rows.select("event_id").distinct().count() > 0


def test_watch(spark):
    rows = spark.createDataFrame([("a:1", 1), ("b:1", 2), ("a:2", 3)], "key string, seq long")
    assert [r["seq"] for r in X.watch(rows, "a:", 1).collect()] == [3] and X.watch(rows).count() == 3


def test_unmatched_rows_of_stream_joins(spark):
    left, right = spark.createDataFrame([(1, 1), (2, 2)], "k long, a long"), spark.createDataFrame([(2, 3), (3, 4)], "k long, b long")
    assert sorted(map(tuple, J.key_join(left, right, "k", "left").select("k", "a", "b").collect())) == [(1, 1, None), (2, 2, 3)]
    assert sorted(map(tuple, J.key_join(left, right, "k", "outer").select("k", "a", "b").collect())) == [(1, 1, None), (2, 2, 3), (3, None, 4)]


def test_sticky_deals_free_partitions_in_turn():
    assert P.sticky(4, ["c1", "c2"], {"c1": [0, 1, 2]}) == {"c1": [0, 1, 2, 3], "c2": []}
    assert P.rebalance(4, ["a", "b"], "sticky", 0, {"a": [1]})[0] == {"a": [0, 1, 3], "b": [2]} and P.sticky(2, ["a"]) == {"a": [0, 1]}
