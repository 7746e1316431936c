import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import gru_lm as M
from tidemark.llm.textops import buffers, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return WORD.findall((text or "").translate(UPPER)) + [None]


def brute(rows, mod=10):
    held = [zlib.crc32(str(i).encode()) % mod == 0 for i, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = {}
    for (i, t), h in zip(rows, held, strict=True):
        own = tokens(t)
        out[i] = (h, len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
    return out


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, found = brute(rows), {r["doc_id"]: r for r in M.op10_lm_scoring(spark, data).collect()}
    assert set(found) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_defined_results(spark):
    rows = [(1, "A a b"), (2, None), (3, ""), (4, "zz " * 30_000), (5, "a b c")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in [*rows, rows[0]]], "doc_id long, text string, score string, row int")
    want = brute([*rows, (1, "A a b")])
    found = M.language_model_scores(docs, vocabulary=4, frequent=3, epochs=1).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 1, 2, 3, 4, 5]
    for r in found:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - base) < 1e-6 * abs(base) and np.isfinite(r["score"]) and r["score"] < 0
    assert M.language_model_scores(docs.limit(0)).collect() == []
    alone = M.language_model_scores(docs.filter("doc_id = 2"), held_out_mod=1).collect()[0]  # nothing to learn from
    assert (alone["held_out"], alone["n_tokens"], alone["n_known"], alone["train_tokens"]) == (True, 1, 0, 0) and np.isfinite(alone["score"])


def net(n=11, hidden=5):
    return M.GRU(np.arange(n, 0, -1).astype(float), hidden, seed=1)


def test_probabilities_sum_to_one():
    m = net()
    h = np.random.default_rng(0).normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(m.log_probs(h, np.full(3, w))[0]) for w in range(11))
    assert np.allclose(total, 1, atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    m = net()
    m.flat = m.flat.astype(np.float64)
    m.p = m.parts(m.flat)
    for k, v in m.p.items():
        v += rng.normal(0, 0.3, v.shape) * (k != "bo")
    x, y = rng.integers(0, 11, (6, 3)), rng.integers(0, 11, (6, 3))
    keep, valid = (rng.random((6, 3)) > 0.3).astype(float), rng.random((6, 3)) > 0.2
    h = np.zeros((3, 5))
    grad = m.parts(m.gradient(x, y, keep, valid, h)[1])
    for name in ("wx", "b", "u", "wc", "bc", "wo", "bo"):
        flat = m.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 6):
            old = flat[k]
            if old < -20:
                continue
            flat[k] = old + 1e-4
            up = m.gradient(x, y, keep, valid, h)[0]
            flat[k] = old - 1e-4
            down = m.gradient(x, y, keep, valid, h)[0]
            flat[k] = old
            assert abs((up - down) / 2e-4 - grad[name].reshape(-1)[k]) < 2e-3


def test_lanes_score_as_one_by_one():
    rng = np.random.default_rng(5)
    m = net(30, 6)
    sizes = rng.integers(1, 200, 25)
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, 30, ptr[-1]).astype(np.int32)
    many = M.score(m, ids, ptr, lanes=7, window=16)
    for d in range(25):
        own = ids[ptr[d] : ptr[d + 1]]
        one = M.score(m, own, np.array([0, len(own)]), lanes=1, window=1000)
        assert abs(one[0] - many[d]) < 1e-2
    assert len(M.score(m, ids[:0], np.array([0]))) == 0


def test_training_learns():
    rng = np.random.default_rng(6)
    m = net(12, 8)
    ids = np.concatenate([np.tile([2, 3, 4], 30) if rng.random() < 0.5 else np.tile([5, 6], 45) for _ in range(20)]).astype(np.int32)
    losses = M.train(m, ids, np.arange(0, len(ids) + 1, 90), epochs=6, lanes=4)
    assert losses[-1] < 0.5 * losses[0]


def test_ends():
    _, starts, _, ptr = words(*buffers(pa.array(["a b", None, "c"])))
    ids, at = M.with_ends(np.array([5, 6, 7], np.int32), ptr)
    assert ids.tolist() == [5, 6, 0, 0, 7, 0] and at.tolist() == [0, 3, 4, 6] and len(starts) == 3


def test_training_reads_every_training_document(spark):
    rows = [(k, f"a b w{k} c") for k in range(3000)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lookup = M.Lookup(np.array([1], np.uint64), np.array([1]), 4)
    for epochs in (1, 2):
        model = net()
        before = {k: v.copy() for k, v in model.p.items()}
        n = sum(len(tokens(t)) for _, t in rows)
        assert M.train_on_all(model, lookup, docs, n, epochs) == (n * epochs, len(rows) * epochs)
        assert any((model.p[k] != before[k]).any() for k in before) and all(np.isfinite(v).all() for v in model.p.values())


def test_lanes_hold_every_word_once_and_no_more():
    rng = np.random.default_rng(8)
    ptr = np.concatenate([[0, 400_000], 400_000 + np.cumsum(rng.integers(0, 9, 255))])  # one long text among short ones
    ids = rng.integers(2, 30, ptr[-1]).astype(np.int32)
    lanes = M.Lanes(M.words_before(ids, ptr), ids, ptr, 256)
    assert sum(a.nbytes for a in (lanes.x, lanes.y, lanes.doc, lanes.first)) < 20 * len(ids)
    seen = {d: [] for d in range(256)}
    for x, y, keep, doc, valid in lanes.windows(1000):
        assert x.size <= 256 * 1000
        for k in range(x.shape[1]):
            own = valid[:, k]
            for d in np.unique(doc[own, k]):
                seen[d].append(y[own & (doc[:, k] == d), k])
            assert ((keep[own, k] == 0) == (x[own, k] == M.END)).all()
    for d in range(256):
        assert np.array_equal(np.concatenate([*seen[d], np.zeros(0, int)]), ids[ptr[d] : ptr[d + 1]])
    cut = M.segments(ptr, 1024)
    assert set(ptr) <= set(cut) and np.diff(cut).max() <= 1024 and np.diff(cut).min() > 0


def test_words_of_held_out_rows_alone_count_as_unseen(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(held, "new " * 50), (1, "a b"), (2, "a")]
    for frequent in (1, 100):
        found = {r["doc_id"]: r for r in M.language_model_scores(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()}
        for i, want in brute(rows).items():
            assert (found[i]["n_known"], found[i]["train_tokens"]) == (want[2], want[3]) and abs(found[i]["base_score"] - want[4]) < 1e-6


def test_frequent_words_fill_up_a_class(spark):
    counts = spark.createDataFrame([(k, 1, 1) for k in range(4000)] + [(9000 + k, 50, 50) for k in range(10)], "h long, c long, t long")
    found = {r["h"] for r in M._most_frequent(counts, 1000)}
    assert set(range(9000, 9010)) <= found and 800 < len(found) < 1200


def test_a_round_averages_tasks_by_words(spark):
    lookup = M.Lookup(np.array([], np.uint64), np.array([]), 4)

    def learnt(texts, parts):
        model = net()
        docs = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], parts), "text string")
        return model.p, M.train_round(model, lookup, docs, 0.01, parts)

    (one, _), (two, _), (both, seen) = learnt(["a"] * 2, 1), learnt(["b b b"] * 3, 1), learnt(["a"] * 2 + ["b b b"] * 3, 2)
    assert seen == (16, 5)
    for k in both:
        assert np.allclose(both[k], (4 * one[k] + 12 * two[k]) / 16, atol=1e-6)


def test_a_step_runs_on_whole_runs_of_memory():
    """CPU budget: gates that lie apart in memory (rows of lanes) took about 40 % more time for a step."""
    m, trace = net(30, 6), []
    rng = np.random.default_rng(9)
    x, keep = rng.integers(0, 30, (5, 8)), (rng.random((5, 8)) > 0.3).astype(np.float32)
    h = rng.normal(0, 0.3, (8, 6)).astype(np.float32)
    found = m.states(x, keep, h, trace)
    assert len(trace) == 5 and all(a.flags.c_contiguous and a.shape == (6, 8) for step in trace for a in step)
    plain = lambda v: 1 / (1 + np.exp(-v))
    for t in range(5):
        h = h * keep[t][:, None]
        gx, gh = m.p["wx"][x[t]] + m.p["b"], h @ m.p["u"]
        z, r = plain(gx[:, :6] + gh[:, :6]), plain(gx[:, 6:12] + gh[:, 6:12])
        c = np.tanh(gx[:, 12:] + r * gh[:, 12:])
        h = c + z * (h - c)
        assert np.allclose(found[t], h, atol=1e-6)


def test_large_logits():
    m = net()
    h = np.random.default_rng(3).normal(size=(4, 5)).astype(np.float32)
    m.p["bo"][::2] = 300
    m.p["wc"][0] = 300
    with np.errstate(over="raise", invalid="raise"):
        lp = np.array([m.log_probs(h, np.full(4, w))[0] for w in range(11)])
    assert np.isfinite(lp).all() and np.allclose(np.exp(lp).sum(0), 1, atol=1e-5)


def test_gradient_of_words_that_come_often():
    """The sums of the rare entry, of one other word and of words that do not come, against one window each."""
    m = net(30, 6)
    x, y = np.full((40, 3), M.RARE), np.full((40, 3), 4)
    x[::4] = 7
    keep, h = np.zeros((40, 3), np.float32), np.zeros((3, 6), np.float32)  # each word stands alone
    whole = m.parts(m.gradient(x, y, keep, np.ones((40, 3), bool), h)[1])["wx"]
    alone = {w: m.parts(m.gradient(np.array([[w]]), np.array([[4]]), keep[:1, :1], np.ones((1, 1), bool), h[:1])[1])["wx"] for w in (M.RARE, 7)}
    assert np.allclose(whole, 0.75 * alone[M.RARE] + 0.25 * alone[7], atol=1e-6) and not whole[2:7].any()
