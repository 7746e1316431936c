"""Every registered query against its SQL, run by another engine on the same tables."""

import math
import os

import pytest

from tidemark.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def canon(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return repr(round(float(v), 9))

    return sorted([tuple(map(one, r)) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    frame = catalog.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE[name]})")
    assert sorted(duck.sql(catalog.ORACLE[name]).columns) == columns
    assert canon(map(tuple, frame.select(*[f"`{c}`" for c in columns]).collect())) == canon(want.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
