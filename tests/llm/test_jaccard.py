import numpy as np

from tidemark.llm import jaccard as J
from tidemark.llm.graph import connected_components


def grams(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n=5, limit=0.8):
    seq = [tuple((t or "").encode().lower().split()) for t in texts]
    first = {}
    for k, s in enumerate(seq):
        first.setdefault(s, k)
    reps = [k for k, s in enumerate(seq) if s and first[s] == k]
    sets = {k: grams(texts[k], n) for k in reps}
    links = {k: [] for k in reps}
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            m = len(sets[a] & sets[b])
            if m and m >= limit * (len(sets[a]) + len(sets[b]) - m):
                links[a].append(b)
                links[b].append(a)
    root = {k: k for k in reps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, own in links.items():
        for b in own:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    out = []
    for k, s in enumerate(seq):
        out.append((k, find(first[s]), first[s], seq.count(s), len(links[first[s]])) if s else (k, k, k, 1, 0))
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", "  \n", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(20, 150)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            own = list(base)
            for i in rng.integers(0, len(own), rng.integers(0, 3)):
                own[i] = rng.choice(vocabulary)
            texts.append(" ".join(own) if rng.random() < 0.7 else "\n".join(own).upper())
    base = list(rng.choice(vocabulary, 120))
    for k in range(50):  # one large group of near copies
        texts.append(" ".join([*base, f"tail{k}"]))
    return texts


def found(spark, texts, **options):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, rep string, links int").repartition(4)
    return sorted(map(tuple, J.near_duplicates(docs, **options).collect()))


def test_against_brute_force(spark):
    texts = corpus()
    assert found(spark, texts) == brute(texts)


def test_large_sets_of_candidates_are_tiled(spark):
    texts = corpus(1)
    assert found(spark, texts, chunk_texts=7) == brute(texts)


def test_other_lengths_and_limits(spark):
    texts = corpus(2)[:30]
    assert found(spark, texts, n=3, similarity=0.6, rows=3) == brute(texts, 3, 0.6)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, J.near_duplicates(docs).collect())) == [(1, 1, 1, 3, 0), (1, 1, 1, 3, 0), (2, 1, 1, 3, 0), (3, 3, 3, 1, 0)]
    assert J.near_duplicates(docs.limit(0)).collect() == []
    kept = J.keep_one(docs.selectExpr("*", "1 as class_id"))
    assert kept.columns == ["doc_id", "text", "class_id"] and sorted({r["doc_id"] for r in kept.collect()}) == [1, 3]


def test_recall_of_the_bands():
    assert 1 - (1 - 0.8**J.ROWS) ** J.bands_for(0.8, 0.999, J.ROWS) >= 0.999


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(5, None)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {k: find(k) for k in root}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
