"""A left join whose hot keys are spread over salts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], least: int = 1000) -> DataFrame:
    """``rows`` left joined with ``facts`` (one row per key, cheap to read again; column n: the key's rows, which is dropped).

    A key with a thousandth of all rows (and ``least``) is hot: at most a thousand keys, so they are broadcast. Their rows
    are dealt by the hash of columns ``by`` over as many salts as make each about a thousandth of all, and their fact is
    copied to these. A null key joins nothing.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    share = max(least, total // 1000)
    hot = F.broadcast(facts.filter(F.col("n") >= share).select(*keys, F.ceil(F.col("n") / share).cast("long").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), salts))
    right = facts.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left.join(right.drop("__salts", "n"), [*keys, "__salt"], "left").drop("__salts", "__salt")
