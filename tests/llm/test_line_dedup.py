import hashlib
from collections import Counter

import numpy as np

from tidemark.llm.line_dedup import PerfectHash, Shard, dedup_lines

BLANK = " \t\n\x0b\x0c\r"
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(BLANK).translate(UPPER)
    lines = [(t or "").split("\n") for t in texts]
    docs = Counter(k for own in lines for k in {key(x) for x in own} if len(k) >= min_chars)
    out = []
    for own in lines:
        kept = [x for x in own if len(key(x)) < min_chars or docs[key(x)] < min_docs]
        out.append(("\n".join(kept), len(own), len(own) - len(kept)))
    return out


def texts():
    rng = np.random.default_rng(0)
    common = ["Shared line", "shared LINE ", "É accent", "é accent", "", "  ", "x", "\tTab\r", "tab"]
    out = [None, "", "\n\n", "only one\n", "x" * 100_000 + "\nShared line"]
    for k in range(40):
        own = [common[i] if i < len(common) else f"line {k} {i}" for i in rng.integers(0, 14, rng.integers(1, 12))]
        out.append("\n".join(own))
    return out


def rows(df):
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in df.orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    t = texts()
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(5)
    for min_docs, min_chars in ((10, 1), (3, 2), (2, 1), (1, 1), (1000, 1)):
        assert rows(dedup_lines(docs, min_docs=min_docs, min_chars=min_chars)) == brute(t, min_docs, min_chars)


def test_the_way_without_a_broadcast_gives_the_same(spark):
    t = texts() + texts()[:9]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    assert rows(dedup_lines(docs, min_docs=4, broadcast_bytes=0)) == brute(t, 4)


def test_clashing_columns_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a\nb", "n", 5)] * 3 + [(2, None, None, None)], "doc_id long, text string, n_lines string, n_dropped int")
    found = dedup_lines(docs, min_docs=3)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(map(tuple, found.collect())) == [(1, "", 2, 2)] * 3 + [(2, "", 1, 0)]
    assert dedup_lines(docs.limit(0)).collect() == []
    assert dedup_lines(docs.limit(0), broadcast_bytes=-1).collect() == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        again = PerfectHash.load(PerfectHash.build(keys).dump())
        assert sorted(again(keys).tolist()) == list(range(len(keys)))


def test_query(spark, data):
    from tidemark.llm.line_dedup import op6_line_dedup

    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: (n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (t, n, d) in zip(docs, brute([r["text"] for r in docs], 10), strict=True)}
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in op6_line_dedup(spark, data).collect()}
    assert found == want


def test_colliding_first_hashes_stay_apart():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 1 << 63, (2, 1000), dtype=np.uint64)
    h1[10:13] = h1[0]
    shard = Shard(*Shard.arrays(h1, h2, np.arange(2, 1002)))
    assert shard.count(h1, h2).tolist() == list(range(2, 1002))
    assert shard.count(h1, h2 ^ np.uint64(1)).tolist() == [0] * 1000
    assert Shard(*Shard.arrays(h1[:0], h2[:0], np.arange(0))).count(h1, h2).tolist() == [0] * 1000


def test_copies_under_other_ids_without_a_broadcast(spark):
    t = ["same\ntext " * 3] * 60 + ["other\ntext", None]
    docs = spark.createDataFrame([(k, x, {"a": 1}) for k, x in enumerate(t)], "doc_id long, text string, more map<string,int>").repartition(4)
    assert rows(dedup_lines(docs, min_docs=10, broadcast_bytes=0)) == brute(t, 10)
