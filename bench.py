"""Seconds of headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators.query import Query  # noqa: E402
from tidemark.plans import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 5


def lineitem(spark) -> Query:
    return Query(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), "l_orderkey")


#: Shapes of a query builder's benchmark, over all rows of lineitem.
SHAPES = {
    "all": lambda q: q.collect(),
    "filter_half": lambda q: q.filter("l_quantity > 25").collect(),
    "filter_tenth": lambda q: q.filter("l_quantity > 45").collect(),
    "order_take_10": lambda q: q.order_by_desc("l_extendedprice").take(10).collect(),
    "first": lambda q: q.first(),
    "count": lambda q: q.count_rows(),
    "sum_by": lambda q: q.sum_by("l_returnflag", "l_extendedprice"),
    "count_by": lambda q: q.count_by("l_suppkey"),
    "group_by": lambda q: q.group_by("l_suppkey").select("l_suppkey", F.size("items")),
    "avg_by": lambda q: q.avg_by("l_discount"),
    "min_by": lambda q: q.min_by("l_extendedprice"),
}
QUERIES = ["agg_flagship", "join_one_to_many_nested", "join_stream_interval", "scan_last_write_wins", "write_upsert", "window_tumbling", "window_sliding", "window_session", "text_search", "page_enumerate", "consumer_poll"]


def seconds(make) -> float:
    """The whole result is computed and thrown away; median after a warm-up."""
    took = []
    for _ in range(REPEATS + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took[1:]), 4)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": CPUS})
    spark.sparkContext.setLogLevel("ERROR")
    out = {name: seconds(lambda f=f: f(lineitem(spark))) for name, f in SHAPES.items()}
    out |= {name: seconds(lambda f=catalog.QUERIES[name]: f(spark, FOLDER)) for name in QUERIES}
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "lineitem_rows": rows, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
