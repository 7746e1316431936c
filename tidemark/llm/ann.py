"""Approximate nearest neighbours: NN-descent builds a neighbour graph by iterative Spark joins; queries walk it greedily.

Equal vectors are one point with its smallest ids. The first graph comes from blocks of points that follow each other in
the order of random signatures; blocks are cut by global ordinals, so they don't depend on partitions and a block of few
points does not occur. Each round joins neighbours of neighbours: a point's neighbours and the points that name it (both
limited to the closest few) meet in one row with their quantised vectors, and pairs with at least one new side that improve
on a list are kept; points without a new neighbour are left out. Rounds go on until few list entries change. The search
keeps, for every query, the best ``beam`` points seen and whether each was expanded; a round moves ids of the neighbours of
the closest unexpanded ones, and vectors only of those not in the beam yet. Distances in the graph are on one-byte
components with a scale per vector; every point of the beam that may be among the nearest by the bound of their error is
compared in double precision on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ordinals import numbered
from tidemark.llm.store import cut, cut_round, stored

K, BLOCK, ORDERS = 32, 256, 3
#: The beam is so many times the binary logarithm of the points; a quarter of it is expanded a round.
BEAM = 24
#: Rounds end when this share of the list entries or less is new; none has been seen to need so many rounds.
CHANGED, MOST_ROUNDS = 0.01, 40


def first_of(df: DataFrame, key: str, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each task's rows before the shuffle, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) with vectors that are neither null, empty nor zero and whose components are all numbers; of an id's vectors the least."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine)
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def quantise(x: np.ndarray) -> list[bytes]:
    scale = np.abs(x).max(1, keepdims=True)
    scale = np.where(np.isfinite(scale) & (scale > 0), scale, 1)
    return [a.tobytes() + b.tobytes() for a, b in zip((scale / 127).astype(np.float64), np.rint(x / scale * 127).astype(np.int8), strict=True)]


def restore(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    return raw[:, 8:].view(np.int8).astype(np.float64) * np.ascontiguousarray(raw[:, :8]).view(np.float64)


def errors(data: list[bytes]) -> np.ndarray:
    """How far each restored vector may be from its original."""
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    return np.ascontiguousarray(raw[:, :8]).view(np.float64).ravel() * (0.5 * np.sqrt(raw.shape[1] - 8) * (1 + 1e-6))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def points_of(rows: DataFrame, members: int) -> DataFrame:
    """(point, members, vec, code): distinct vectors, each with its smallest ids; a further id can't be among the nearest."""
    keyed = rows.withColumn("__k", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")))
    few = first_of(keyed, "__k", ["vec_id"], members)
    grouped = few.groupBy("__k").agg(F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("members"), F.first("vec").alias("vec")).drop("__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quantise(matrix(batch.column(2))), pa.binary())], names=["point", "members", "vec", "code"])

    return stored(grouped.mapInArrow(run, "point long, members array<long>, vec array<double>, code binary"), "points")


def first_graph(points: DataFrame, k: int, orders: int, block: int) -> DataFrame:
    """(u, v, d): neighbours within blocks of points that follow each other by a random signature."""
    out = None
    for seed in range(orders):

        def signature(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = restore(batch.column(1).to_pylist())
                    side = x @ np.random.default_rng(seed).normal(size=(x.shape[1], 16))
                    key = [np.packbits(s > 0).tobytes() for s in side]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary()), pa.array(side[:, 0])], names=["point", "code", "sign", "side"])

        def near(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, x = pdf["point"].to_numpy(np.int64), restore(pdf["code"].tolist())
            if len(ids) < 2:
                return pd.DataFrame({"u": ids[:0], "v": ids[:0], "d": np.zeros(0)})
            d = distances(x, x)
            np.fill_diagonal(d, np.inf)
            m = min(k, len(ids) - 1)
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            return pd.DataFrame({"u": np.repeat(ids, m), "v": ids[at.ravel()], "d": np.take_along_axis(d, at, 1).ravel()})

        dealt = points.select("point", "code").mapInArrow(signature, "point long, code binary, sign binary, side double")
        order, total = numbered(dealt, ["sign", "side", "point"], "order")
        place = F.least(F.floor(F.col("g") / block), F.lit(max(1, total // block) - 1)).cast("long")
        edges = order.withColumn("block", place).groupBy("block").applyInPandas(near, "u long, v long, d double")
        out = edges if out is None else out.unionByName(edges)
    return out


def lists(edges: DataFrame, k: int) -> DataFrame:
    """The closest ``k`` of each point's distinct neighbours; a pair once seen stays old."""
    pairs = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return first_of(pairs, "u", ["d", "v"], k)


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """(w, v, fresh): each point's neighbours and the closest ``k`` of those that name it."""
    back = first_of(graph.select(F.col("v").alias("w"), F.col("u").alias("v"), "d", "fresh"), "w", ["d", "v"], k)
    return graph.select(F.col("u").alias("w"), "v", "d", "fresh").unionByName(back).groupBy("w", "v").agg(F.max("fresh").alias("fresh"))


def gathered(graph: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(w, near): the neighbours both ways of each point that has a new one, with their codes and limits."""
    moved = both_ways(graph, k).groupBy("w").agg(F.collect_list(F.struct("v", "fresh")).alias("own")).filter(F.exists("own", lambda x: x.fresh > 0))
    both = moved.select("w", F.explode("own").alias("x")).select("w", "x.v", "x.fresh")
    limit = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).alias("most"))
    known = points.select(F.col("point").alias("v"), "code").join(limit.withColumnRenamed("u", "v"), "v", "left")
    return both.join(known, "v").groupBy("w").agg(F.collect_list(F.struct("v", "fresh", "most", "code")).alias("near"))


def unpack(near: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    flat = near.flatten()
    most = flat.field("most").to_numpy(zero_copy_only=False)
    return near.offsets.to_numpy() - near.offsets[0].as_py(), flat.field("v").to_numpy(zero_copy_only=False), flat.field("fresh").to_numpy(zero_copy_only=False), np.where(np.isnan(most), np.inf, most), flat.field("code").to_pylist()


def improve(near: DataFrame) -> DataFrame:
    """(u, v, d): pairs of neighbours of one point that are closer than the first one's list reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                off, ids, fresh, most, codes = unpack(batch.slice(k, 500).column(1))
                x = restore(codes)
                u, v, dd = [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    d = distances(x[a:b], x[a:b])
                    ok = (d < most[a:b, None]) & ((fresh[a:b, None] + fresh[None, a:b]) > 0)
                    np.fill_diagonal(ok, False)
                    i, j = np.nonzero(ok)
                    u.append(ids[a + i]), v.append(ids[a + j]), dd.append(d[i, j])
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v)), pa.array(np.concatenate(dd))], names=["u", "v", "d"])
                out = pa.Table.from_batches([out]).group_by(["u", "v"]).aggregate([("d", "min")])
                yield from out.select(["u", "v", "d_min"]).rename_columns(["u", "v", "d"]).to_batches()

    return near.mapInArrow(run, "u long, v long, d double")


def neighbour_graph(points: DataFrame, k: int = K, changed: float = CHANGED, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(u, v, d, fresh): NN-descent; each round's graph is a checkpoint in the shared folder."""
    graph = cut_round(lists(first_graph(points, k, orders, block).withColumn("fresh", F.lit(1)), k))
    for _ in range(MOST_ROUNDS):
        found = improve(gathered(graph, points, k)).withColumn("fresh", F.lit(1))
        graph = cut_round(lists(graph.withColumn("fresh", F.lit(0)).unionByName(found), k))
        new, every = graph.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.count("*")).first()
        if new <= changed * every:
            break
    return graph


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int = K, beam: int | None = None, expand: int | None = None) -> DataFrame:
    """(q, node, d, e): the ``beam`` closest points found for each query point, which the walk starts from itself; d is within e of their distance."""
    beam = beam or max(64, math.ceil(BEAM * math.log2(2 + points.count())))
    expand = expand or max(1, beam // 4)
    links = stored(both_ways(graph, k).groupBy("w").agg(F.collect_list("v").alias("near")).withColumnRenamed("w", "node"), "graph")
    codes = points.select(F.col("point").alias("node"), F.col("code").alias("there"))
    asked = cut(queries.select(F.col("point").alias("q")).join(points.select(F.col("point").alias("q"), F.col("code").alias("here")), "q"))
    state = asked.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(0.0).alias("e"), F.lit(0).alias("done"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                if not part.num_rows:
                    continue
                here, there = part.column(2).to_pylist(), part.column(3).to_pylist()
                d = np.sqrt(((restore(there) - restore(here)) ** 2).sum(1))
                keep = d < part.column(4).to_numpy(zero_copy_only=False)
                e = errors(there) + errors(here)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[keep]), pa.array(part.column(1).to_numpy()[keep]), pa.array(d[keep]), pa.array(e[keep])], names=["q", "node", "d", "e"])

    while True:  # a point is expanded once for each query
        todo = cut_round(first_of(state.filter("done = 0"), "q", ["d", "node"], expand).select("q", "node"))
        if todo.isEmpty():
            break
        reach = state.groupBy("q").agg(F.when(F.count("*") >= beam, F.max("d")).otherwise(float("inf")).alias("limit"))
        met = todo.join(links, "node").select("q", F.explode("near").alias("node")).distinct().join(state.select("q", "node"), ["q", "node"], "left_anti")
        met = met.join(codes, "node").join(asked, "q").join(reach, "q").select("q", "node", "here", "there", "limit")
        met = met.mapInArrow(run, "q long, node long, d double, e double").withColumn("done", F.lit(0))
        marked = state.join(todo.withColumn("now", F.lit(1)), ["q", "node"], "left").select("q", "node", "d", "e", F.greatest("done", F.coalesce("now", F.lit(0))).alias("done"))
        state = cut_round(first_of(marked.unionByName(met), "q", ["d", "node"], beam))
    return state.select("q", "node", "d", "e")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id of rows of ``vectors``) its ``top`` nearest found.

    ``vectors`` has vec_id and embedding. Nulls, empty and zero vectors and those holding null, NaN or infinity take no
    part; a query of these has no result. Vectors of different lengths have no distance: each length is searched by
    itself. Nearest first, ties to the smaller vec_id; a query's own id is no candidate. Repeated rows of an id count
    once, with the least vector. All candidates come back if they are fewer; an empty table gives an empty one.
    """
    rows = stored(usable(vectors), "vectors")
    asked = queries.select(F.col("vec_id").cast("long")).distinct()
    sizes = [r["n"] for r in rows.select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]  # the lengths that occur: as a rule one
    found = [_nearest(rows.filter(F.size("vec") == n), asked, top, **options) for n in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(rows: DataFrame, asked: DataFrame, top: int, **options) -> DataFrame:
    points = points_of(rows, top + 1)
    asked = asked.join(rows, "vec_id", "left_semi")
    keyed = points.select("point", F.explode("members").alias("vec_id"))  # an asked id may be beyond the few of its point
    direct = asked.join(keyed, "vec_id", "left")
    lost = direct.filter("point is null").select("vec_id").join(rows, "vec_id").select("vec_id", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))
    again = lost.join(points.select("point", F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")), ["a", "b"]).select("vec_id", "point")
    owned = cut(direct.filter("point is not null").select("vec_id", "point").unionByName(again))
    graph = neighbour_graph(points, **{k: v for k, v in options.items() if k in ("k", "changed", "orders", "block")})
    found = search(graph, points, owned.select("point").distinct(), **{k: v for k, v in options.items() if k in ("k", "beam", "expand")})
    sure = first_of(found.withColumn("reach", F.col("d") + F.col("e")), "q", ["reach", "node"], top + 1).groupBy("q").agg(F.max("reach").alias("reach"))
    close = found.join(sure, "q").filter(F.col("d") - F.col("e") <= F.col("reach")).select("q", "node")
    pairs = close.join(points.select(F.col("point").alias("node"), "members", F.col("vec").alias("there")), "node").join(points.select(F.col("point").alias("q"), F.col("vec").alias("here")), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.sqrt(((matrix(batch.column(2)) - matrix(batch.column(3))) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["q", "members", "score"])

    scored = pairs.select("q", "members", "here", "there").mapInArrow(exact, "q long, members array<long>, score double")
    every = owned.withColumnRenamed("point", "q").join(scored, "q").select(F.col("vec_id").alias("query_id"), F.explode("members").alias("vec_id"), "score").filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
