from pyspark.sql import functions as F

import corpus_pipeline as C
from tidemark.llm import decontam as D
from tidemark.llm import packing as P


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kinds = docs.dtypes
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, data).persist()
        assert docs.dtypes == kinds, name
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before), name
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "line_dedup":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "ngram_jaccard":
            from tests.llm.test_jaccard import brute

            ids = sorted(before)
            assert set(after) == {ids[k] for k, root, *_ in brute([before[i]["text"] for i in ids]) if k == root}
        if name == "decontamination":
            bench = [D.normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            holds = {i for i, r in before.items() if any(b in D.normal(r["text"]) for b in bench)}
            assert holds and not holds & set(after) and len(before) - len(after) <= len(holds) + 2
        assert all(after[i]["text"] is not None for i in after)
    packed = C.STAGES[-1][1](spark, docs, data).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) <= -(-total // P.CAPACITY) + 2


def test_odd_rows_and_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", None, None), (10**9 + 1, "", None, "s", 0), (10**9 + 2, "123", "en", "s", 3)], docs.schema)
    mixed = docs.limit(60).unionByName(odd).withColumn("lang_pred", F.lit("z"))
    for _, stage in C.STAGES:
        mixed = stage(spark, mixed, data).persist()
        assert mixed.count() > 0
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, data)
        assert empty.count() == 0
