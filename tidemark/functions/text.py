"""Text search: an index of term frequencies and a ranked lookup, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of more than one byte, in order, with repeats."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def text_index(df: DataFrame, pk: str, field: str) -> DataFrame:
    """(token, pk, tf)."""
    return df.select(pk, F.explode(tokenize(field)).alias("token")).groupBy("token", pk).agg(F.count("*").alias("tf"))


def query_tokens(query: str) -> list[str]:
    """Lower-cased words of a query, split at white space; a repeated word counts each time."""
    return query.lower().split()


def search(index: DataFrame, pk: str, query: str, limit: int | None = None) -> DataFrame:
    """(pk, score): sum of the frequencies of the query's tokens, best first, ties by key."""
    words = query_tokens(query)
    weight: dict[str, int] = {}
    for w in words:
        weight[w] = weight.get(w, 0) + 1
    if not weight:
        return index.select(pk, F.col("tf").alias("score")).limit(0)
    times = F.create_map(*[x for w, n in weight.items() for x in (F.lit(w), F.lit(n).cast("long"))])
    hits = index.filter(F.col("token").isin(list(weight)))  # reaches the scan of a stored index
    ranked = hits.groupBy(pk).agg(F.sum(F.col("tf") * times[F.col("token")]).alias("score")).orderBy(F.desc("score"), pk)
    return ranked if limit is None else ranked.limit(limit)


def search_rows(df: DataFrame, pk: str, field: str, query: str, limit: int | None = None) -> DataFrame:
    """search() without an index: occurrences of the query's tokens are counted in each text, nothing is exploded."""
    import re

    weight: dict[str, int] = {}
    for w in query_tokens(query):
        weight[w] = weight.get(w, 0) + 1
    known = [w for w in weight if len(w.encode()) > 1 and not re.search(r"[\W_]", w)]  # others are no token of the index
    if not known:
        return df.select(pk, F.lit(0).cast("long").alias("score")).limit(0)
    low = F.lower(field)
    score = sum((F.regexp_count(low, F.lit(f"{w}(?<![\\p{{L}}\\p{{N}}]{w})(?![\\p{{L}}\\p{{N}}])")).cast("long") * weight[w] for w in known), F.lit(0).cast("long"))
    some = df.select(pk, score.alias("score")).filter("score > 0")
    ranked = some.groupBy(pk).agg(F.sum("score").alias("score")).orderBy(F.desc("score"), pk)
    return ranked if limit is None else ranked.limit(limit)


def save_text_index(df: DataFrame, pk: str, field: str, path: str, buckets: int = 16) -> None:
    """A text index in folders by the token's hash, sorted by token: a search reads the folders of its tokens."""
    index = text_index(df, pk, field).withColumn("bucket", token_bucket(F.col("token"), buckets))
    index.repartition("bucket").sortWithinPartitions("token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def search_stored(spark: SparkSession, path: str, pk: str, query: str, limit: int | None = None, buckets: int = 16) -> DataFrame:
    """search() on a saved index."""
    words = sorted(set(query_tokens(query)))
    found = spark.createDataFrame([(w,) for w in words], "w string").select(token_bucket(F.col("w"), buckets).alias("b")).distinct().collect()  # a row per word at most
    index = spark.read.parquet(path)
    return search(index.filter(F.col("bucket").isin([r["b"] for r in found])).drop("bucket"), pk, query, limit)


def search_tokenized(index: DataFrame, pk: str, query: str, limit: int | None = None) -> DataFrame:
    """The same scoring with the index's own rule for tokens applied to the query."""
    import re

    words = [w for w in re.split(r"[\W_]+", query.lower()) if len(w.encode()) > 1]
    return search(index, pk, " ".join(words), limit)
