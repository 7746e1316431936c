"""URL filters by association rules.

Each labelled URL is a transaction of tokens (host labels, host, path segments, query keys; numbers count as one token)
and its label; tokens that occur in exactly the same URLs are one item. Spark's FP-growth mines frequent combinations;
those that imply the label ``bad`` surely more often than it occurs in all (lift, and a lower bound of the confidence),
and more than every shorter combination they contain, are the rules. Matching goes through an inverted index from token to
rule: a URL matches a rule when it holds all its tokens.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

BAD = "label=bad"
#: Fixed values: (verdict, host, path prefix) of the block and allow lists.
LISTS = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with host (after the first :// up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the end).

    A null url or one without :// has both empty. Columns of these names are replaced.
    """
    rows = pages.drop("host", "path").withColumn("__url", F.coalesce("url", F.lit("")))
    rows = rows.withColumn("__rest", F.when(F.instr("__url", "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(""))
    host = F.regexp_extract("__rest", r"^([^/?#]*)", 1)
    rows = rows.withColumn("__host", host)
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^([^?#]*)", 1)
    return rows.withColumn("host", F.translate("__host", UPPER, LOWER)).withColumn("path", path).drop("__url", "__rest", "__host")


def listed(lists=LISTS):
    """(rule, verdict) of the longest rule that fits a row's host and path, as columns; null without one.

    A rule fits its host and all subdomains if the path starts with its path. Longest is by the rule's text; a later rule
    of the same text does not count.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, prefix in sorted(lists, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, host + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens():
    """Distinct tokens of a row's host, path and url."""
    number = lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.regexp_replace(x, "[0-9]+", "#"))
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), number(x)))
    segments = F.transform(F.split(F.translate("path", UPPER, LOWER), "/"), lambda x: F.concat(F.lit("p:"), number(x)))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    every = F.array_distinct(F.concat(labels, segments, keys))
    return F.filter(every, lambda x: F.length(x) > 2)


def least_share(share: float, n: float, z: float) -> float:
    """Wilson's lower bound of a share seen in ``n`` rows."""
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, min_support: float, min_lift: float, min_count: int = 20, z: float = 3.0) -> list[tuple[tuple[str, ...], float, float]]:
    """Rules (tokens, confidence, support) for the label bad from (tokens, bad) rows; all labelled rows and all their frequent tokens count.

    A rule's confidence is at least ``min_lift`` times the share of bad rows and its lower bound (``z``) above that share;
    it and the label need ``min_support`` of the rows and ``min_count`` rows together. Rows of any number of frequent items
    are mined at this support. An item with fewer bad rows is in no rule, and one that all rows hold makes none surer; both
    stay out. FP-growth's work grows with the number of frequent sets. No labelled row, or none that is bad, gives no rule.
    """
    labelled = stored(labelled.withColumn("id", F.monotonically_increasing_id()), "labelled")
    total, bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    if not total or not bad:
        return []
    base = bad / total
    each = labelled.select("id", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    rows = lambda k: F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)"))
    alike = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("hit"), rows(0).alias("a"), rows(1).alias("b"))
    least = math.ceil(max(min_support * total, min_count) - 1e-9)
    if least > total or min_lift * base > 1:
        return []
    items = stored(alike.filter((F.col("hit") >= least) & (F.col("n") < total)).groupBy("n", "hit", "a", "b").agg(F.min("token").alias("item"), F.sort_array(F.collect_list("token")).alias("tokens")), "items")
    baskets = each.join(items.select(F.col("item").alias("token")), "token").groupBy("id", "bad").agg(F.collect_list("token").alias("own"))
    # Rows without a frequent token still count in supports.
    empty = F.array().cast("array<string>")
    whole = labelled.select("id", "bad").join(baskets.select("id", "own"), "id", "left")
    sets = whole.select(F.concat(F.coalesce("own", empty), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(empty)).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_lift * base).fit(sets)
    rules = frequent.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select("antecedent", "confidence", "support")
    surer = [(tuple(sorted(r[0])), r[1], r[2]) for r in rules.toLocalIterator() if least_share(r[1], r[2] * total / r[1], z) > base]
    confidence: dict[tuple[str, ...], float] = {}
    for need, c, _ in sorted(surer, key=lambda r: (len(r[0]), r[0])):
        parts = [confidence[p] for k in range(1, len(need)) for p in combinations(need, k) if p in confidence]
        if not parts or c > max(parts) + 1e-9:  # a longer rule has to be surer than all it contains
            confidence[need] = c
    named = {r["item"]: r["tokens"] for r in items.filter(F.col("item").isin(sorted({t for need in confidence for t in need}))).collect()} if confidence else {}
    return [(tuple(sorted(t for item in need for t in named[item])), c, s) for need, c, s in sorted(surer, key=lambda r: (len(r[0]), r[0])) if confidence.get(need) == c]


def matched(rows: DataFrame, rules: list[tuple[tuple[str, ...], float, float]]) -> DataFrame:
    """``rows`` (with tokens) and ``mined``: the tokens of the surest rule that it matches, joined by blanks; else null.

    The index from token to rule holds what the mining found; every rule has the minimum support.
    """
    index: dict[str, list[int]] = defaultdict(list)
    for k, (need, _, _) in enumerate(rules):
        for token in need:
            index[token].append(k)
    order = np.argsort([(-c) for _, c, _ in rules], kind="stable")
    place = {int(k): i for i, k in enumerate(order)}
    shared = rows.sparkSession.sparkContext.broadcast((dict(index), [len(r[0]) for r in rules], place, [" ".join(r[0]) for r in rules]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, rank, name = shared.value
        for batch in batches:
            out = []
            for own in batch.column(batch.num_columns - 1).to_pylist():
                hits: dict[int, int] = defaultdict(int)
                for token in own or ():
                    for k in found.get(token, ()):
                        hits[k] += 1
                full = [k for k, n in hits.items() if n == size[k]]
                out.append(name[min(full, key=rank.__getitem__)] if full else None)
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "mined"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "tokens") + ", mined string"
    return rows.select(*[c for c in rows.columns if c != "tokens"], "tokens").mapInArrow(run, schema)


def judge_urls(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_lift: float = 1.5, lists=LISTS) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, mined) of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) label the page of the same id: bad if quality is 0 or toxic is 1; a null counts
    as good, and of several labels of one id any bad one holds. The lists' verdict holds where a rule fits; else block
    where a mined rule matches, else allow. Null urls have no token and are allowed. Urls of any length
    are read whole. Repeated rows come back as often; other columns are ignored.
    """
    rows = split_urls(pages.select("page_id", "url")).withColumn("tokens", tokens())
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    rules = mine(rows.join(known, "page_id").select("tokens", "bad"), min_support, min_lift)
    rule, verdict = listed(lists)
    found = matched(rows, rules)
    return found.select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("url")
