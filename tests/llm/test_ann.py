import numpy as np

from tidemark.llm import ann as A


def brute(rows, asked, top=10):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = {}
    for q in asked:
        if q in ok:
            near = sorted((np.sqrt(((ok[q] - v) ** 2).sum()), i) for i, v in ok.items() if i != q)[:top]
            out[q] = near
    return out


def run(spark, rows, asked, **options):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, point string, q int").repartition(3)
    found = {}
    for r in A.nearest(vectors, spark.createDataFrame([(q,) for q in asked], "vec_id long"), **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(own) for q, own in found.items()}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[1000:1200] = x[0] + rng.normal(size=(200, 24)) * 0.01
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    asked = list(range(0, 1500, 50))
    want, found = brute(rows, asked), run(spark, rows, asked)
    assert set(found) == set(want)
    hit = sum(len({i for _, i in want[q]} & {i for _, i, _ in found[q]}) for q in asked)
    assert hit >= 0.9 * 10 * len(asked)
    for q in asked:
        assert [r for r, _, _ in found[q]] == list(range(1, 11))
        for _, i, s in found[q]:
            assert abs(s - np.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12
        assert [(s, i) for _, i, s in found[q]] == sorted((s, i) for _, i, s in found[q])


def test_odd_vectors_copies_and_ties(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, float("inf")]), (7, [1.0, 2.0, 3.0])]
    rows += [(100 + k, [1.0, 1.0]) for k in range(30)] + [(200, [1.0, 2.0]), (201, [0.0, 1.0]), (202, [1e6, 1e6]), (203, [2.0, 1.0])]
    asked = [3, 5, 7, 100, 129, 200, 202, 999]
    want, found = brute([r for r in rows if r[0] != 7], asked), run(spark, rows, asked)
    assert set(found) == {100, 129, 200, 202}
    for q, own in found.items():
        assert [(i, round(s, 9)) for _, i, s in own] == [(i, round(float(s), 9)) for s, i in want[q]]


def test_few_and_none(spark):
    assert run(spark, [(1, [1.0]), (2, [3.0])], [1, 1]) == {1: [(1, 2, 2.0)]}
    assert run(spark, [(1, [1.0])], [1]) == {}
    assert run(spark, [(1, None)], [1]) == {}


def test_any_partitioning_gives_all_candidates(spark):
    rng = np.random.default_rng(7)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(30, 8)))] + [(100 + k, [float(k), 1.0]) for k in range(4)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        found = run(spark, rows, [0, 29, 100])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {**brute(rows[:30], [0, 29]), **brute(rows[30:], [100])}  # lengths are searched by themselves
    assert {q: [i for _, i, _ in own] for q, own in found.items()} == {q: [i for _, i in own] for q, own in want.items()}
    assert len(found[0]) == 10 and len(found[100]) == 3


def test_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    asked = [i for i, _ in rows if i % 100 == 0]
    want, found = brute(rows, asked), {}
    for r in A.op5_nearest_neighbours(spark, data).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(want)
    assert sum(len(found[q] & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_one_id_with_two_vectors_has_the_least(spark):
    assert run(spark, [(1, [5.0]), (1, [2.0]), (2, [3.0])], [2]) == {2: [(1, 1, 1.0)]}


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """Their digits doubled from round to round, up to a driver full of them."""
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    points = A.points_of(A.usable(vectors), 11)
    graph = A.neighbour_graph(points, k=8)
    state = A.search(graph, points, points.filter("point % 100 = 0").select("point"), k=8, beam=32)
    for frame in (graph, state):
        assert frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
