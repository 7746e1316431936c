import numpy as np

from tidemark.llm import decontam as D


def slow(pattern, text):
    """Edit distance of the pattern to the nearest substring, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = bytes(rng.integers(97, 100, rng.integers(1, 12)).tolist()), bytes(rng.integers(97, 100, rng.integers(0, 25)).tolist())
        want = slow(a, b)
        got = D.edit_distance_within(a, b, 4)
        assert got[0] == (want if want <= 4 else 5)


def test_walk_of_equal_strings_is_equal_and_near_ones_stay_near():
    rng = np.random.default_rng(1)
    a = rng.integers(97, 122, (50, 200)).astype(np.uint8)
    b = a.copy()
    b[:, 100] = 65
    c = np.concatenate([a[:, :50], a[:, 51:], np.full((50, 1), 97, np.uint8)], 1)
    x, y, z = (D.cgk(m, 400, 5) for m in (a, b, c))
    assert (D.cgk(a, 400, 5) == x).all()
    other = D.cgk(rng.integers(97, 122, (50, 200)).astype(np.uint8), 400, 5)
    assert (x != y).mean() < 0.2 and (x != z).mean() < 0.3 < 0.8 < (x != other).mean()


def items(n=25, seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(2000)]
    return [(k, " ".join(rng.choice(vocabulary, rng.integers(15, 50)))) for k in range(n)], vocabulary, rng


def test_exact_and_edited_passages_are_found_and_clean_texts_are_not(spark):
    bench, vocabulary, rng = items()
    rows, truth = [], set()
    for k in range(400):
        filler = list(rng.choice(vocabulary, rng.integers(5, 200)))
        if k % 2:
            i, text = bench[k % len(bench)]
            own = text.split()
            if k % 4 == 1:
                for j in rng.integers(0, len(own), max(1, len(own) // 12)):
                    own[j] = rng.choice(vocabulary)
            at = rng.integers(0, len(filler) + 1)
            filler[at:at] = own if k % 3 else [w.upper() + "\n" for w in own]
            truth.add((k, i))
        rows.append((k, " ".join(filler), "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    norm = {i: D.normal(t) for i, t in bench}
    truth = {(k, i) for k, i in truth if D.edit_distance_within(norm[i], D.normal(rows[k][1]), int(0.2 * len(norm[i])))[1] >= 0}
    found = D.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got <= truth and len(truth - got) <= 0.03 * len(truth)
    kept = D.drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, *_ in rows} - {k for k, _ in got}


def test_blocks_of_items_give_the_same(spark):
    bench, _, _ = items(8)
    docs = spark.createDataFrame([(k, "x y " + t + " z") for k, t in bench] + [(99, None), (98, "")], "doc_id long, text string")
    frame = spark.createDataFrame([*bench, (50, None), (51, "  ")], "item_id long, text string")
    for size in (1, 10, 1 << 20):
        assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in D.contaminated(docs, frame, block_bytes=size).collect()) == [(k, k, 0) for k, _ in bench]


def edited(text, rate, rng, spread=False):
    """``rate`` of the characters changed: at random places, or one in every few characters."""
    out, n = list(text), round(rate * len(text))
    for k in range(n):
        at = int((k + 0.5) * len(out) / n) if spread else int(rng.integers(0, len(out)))
        kind = rng.integers(0, 3)
        if kind < 2:
            out[at : at + 1] = ["q"] if kind else []
        else:
            out.insert(at, "z")
    return "".join(out)


def test_recall_of_edited_passages():
    bench, vocabulary, rng = items(120, 5)
    block = D.Items(bench, 0.2, 0.99)
    for rate, spread, least in ((0.05, False, 0.99), (0.1, False, 0.98), (0.1, True, 0.97), (0.15, False, 0.95), (0.2, False, 0.9), (0.2, True, 0.75)):
        texts = [" ".join([*rng.choice(vocabulary, int(rng.integers(2, 30))), edited(t, rate, rng, spread), *rng.choice(vocabulary, 12)]) for _, t in bench]
        want = {(k, bench[k][0]) for k, t in enumerate(texts) if D.edit_distance_within(D.normal(bench[k][1]), D.normal(t), int(0.2 * len(D.normal(bench[k][1]))))[1] >= 0}
        data = "".join(texts).encode()
        got = {(r[0], r[1]) for r in D.scan(block, list(range(len(texts))), np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))}
        assert len(got & want) >= least * len(want), (rate, spread, len(got & want), len(want))


def test_texts_are_normal():
    raw = ["  A\tb\n", "", "É x\0y ", " \n"]
    data = [t.encode() for t in raw]
    texts = D.Texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    assert texts.data.tobytes() == D.normal(raw[0]) + b"\0" + D.normal(raw[2]) + b"\0"
    assert texts.ptr.tolist() == [0, 2, 2, 4, 4]


def test_clashing_columns_and_nulls_when_dropping(spark):
    docs = spark.createDataFrame([(None, "say hello brave new world now", 1, {"a": 1}), (2, None, 2, None), (2, "fine", 3, None)], "doc_id long, text string, item_id int, m map<string,int>")
    kept = D.drop_contaminated(docs, spark.createDataFrame([(7, "hello brave new World")], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["item_id"] for r in kept.collect()) == [2, 3]


def test_very_long_text(spark):
    bench, vocabulary, rng = items(5)
    text = " ".join([*rng.choice(vocabulary, 200_000), bench[3][1], *rng.choice(vocabulary, 200_000)])
    found = D.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert [(r["item_id"], r["start_word"], r["edits"]) for r in found] == [(3, 200_000, 0)]


def test_short_items_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "say hello world now"), (1, "say hello world now"), (2, "hello")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Hello  World"), (8, "now")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()) == [(1, 7)] * 2 + [(1, 8)] * 2
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.contaminated(docs.limit(0), bench).collect() == []
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 3


def test_query(spark, data):
    docs = {r["doc_id"]: D.normal(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    bench = {r["item_id"]: D.normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, b in bench.items() if b in t}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in D.op9_decontamination(spark, data).collect()}
    assert want == {k for k, e in got.items() if e == 0}
