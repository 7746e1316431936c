import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import langid as G


def test_held_out_accuracy(spark, data):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = G.op8_language_id(spark, data).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def model(spark):
    texts = [("der und die nicht " * 20, "de"), ("the and of with " * 20, "en"), ("le la les une " * 20, "fr")]
    docs = spark.createDataFrame([(k, *texts[k % 3], "src") for k in range(90)] + [(90, None, "xx", None), (91, "hello", None, None)], "doc_id long, text string, lang string, source string")
    return G.train(docs)


def test_defined_results(spark):
    m = model(spark)
    assert m.langs == ["de", "en", "fr"]
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 ?!", "c"), (4, "the and of with", "d"), (5, "der und die " * 50_000, "e"), (5, "der und die", None)], "doc_id long, text string, score string")
    found = G.identify(docs, m)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    rows = found.orderBy("doc_id", F.length("text")).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und", "und", "en", "de", "de"]
    assert [r["score"] for r in rows[:3]] == [0, 0, 0] and not any(r["ambiguous"] for r in rows[:3])
    assert G.identify(docs.limit(0), m).collect() == []


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert G.train(docs) is None and G.train(docs.limit(0)) is None
    assert [r["lang_pred"] for r in G.identify(docs, None).collect()] == ["und"]


def test_one_language(spark):
    docs = spark.createDataFrame([(k, "abc def", "en") for k in range(20)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in G.identify(docs, G.train(docs)).collect()} == {"en"}


def test_codewords_are_apart():
    for n in (2, 3, 5, 12, 60):
        code = G.codewords(n).astype(int)
        far = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        assert far >= (1 if n == 2 else code.shape[1] // 4)


def test_score_ignores_labels(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    m = model(spark)
    a = {r["doc_id"]: r["lang_pred"] for r in G.identify(docs, m).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in G.identify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")), m).collect()}
    assert a == b


def test_decoding_against_brute_force(spark, data):
    import math

    m = model(spark)
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect() if r["text"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in G.identify(docs, m).collect()}
    for k, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        x = G.features(raw, np.array([0, len(raw)]), m.bits)[0].astype(float)
        loss = []
        for word in m.code:  # the loss-weighted distance to every codeword, bit by bit
            z = [sum(float(a) * float(b) for a, b in zip(x[x > 0], m.weights[x > 0, j], strict=True)) + float(m.bias[j]) for j in range(len(word))]
            loss.append(sum(float(w) * math.log1p(math.exp(-int(c) * v)) for c, v, w in zip(word, z, m.bit_weight, strict=True)))
        share = [math.exp(min(loss) - v) for v in loss]
        assert found[k]["lang_pred"] == m.langs[loss.index(min(loss))] and abs(found[k]["score"] - max(share) / sum(share)) < 1e-3


def test_features_against_brute_force():
    from collections import Counter

    text = "Ab, c--d  É9"
    raw = np.frombuffer(text.encode(), np.uint8)
    got = G.features(raw, np.array([0, len(raw)]), 12)[0]
    clean = []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32
        if b != 32 or not clean or clean[-1] != 32:
            clean.append(b)
    for order, (base, width) in enumerate(((0, 1024), (1024, 1024), (2048, 2048))):
        padded = [*clean, 32, 32]
        grams = [int.from_bytes(bytes(padded[i : i + order + 1]), "big") for i in range(len(clean))]
        want = Counter(((g * 2654435769) & 0xFFFFFFFF) >> (32 - width.bit_length() + 1) for g in grams)
        assert np.allclose(got[base : base + width], [np.sqrt(want[s] / len(grams)) for s in range(width)], atol=1e-6)


def test_every_language_is_learnt(spark):
    docs = spark.createDataFrame([(40 * k + i, f"word{chr(97 + k % 26)}{chr(97 + k // 26)} " * 9, f"l{k:03d}") for k in range(230) for i in range(40)], "doc_id long, text string, lang string")
    m = G.train(docs, sample_rows=230, bits=8)
    assert len(m.langs) == 230
