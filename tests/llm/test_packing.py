import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as P


def check_plan(counts, capacity, plan, bins):
    """Every item once, no overlap, no gap from 0, nothing over the capacity."""
    seen, filled = {}, {}
    for length, r0, r1, first, place in plan:
        for r in range(r0, r1):
            assert (length, r) not in seen
            seen[length, r] = True
            filled.setdefault(first + r - r0, []).append((place, length))
    assert len(seen) == sum(counts.values()) and all(r < counts[k] for k, r in seen)
    assert sorted(filled) == list(range(bins))
    for own in filled.values():
        at = 0
        for place, length in sorted(own):
            assert place == at
            at += length
        assert at <= capacity


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20), st.sampled_from([0.2, 1 / 3, 0.5]), st.integers(1, 8))
def test_plans_are_whole(counts, large, groups):
    plan, bins = P.pack_histogram(counts, 64, groups, large)
    check_plan(counts, 64, plan, bins)
    assert bins >= -(-sum(k * v for k, v in counts.items()) // 64)


def test_few_sequences():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 30_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan, bins = P.pack_histogram(counts)
    check_plan(counts, 2048, plan, bins)
    assert bins <= 1.002 * -(-int(lengths.sum()) // 2048) + 1


def test_configurations_beat_one_size_each():
    found = P.configurations([60, 40], [100, 100], 100)
    assert sum(n for _, n in found) == 100 and all(c == {60: 1, 40: 1} for c, _ in found)


def test_cut_pieces():
    assert P.cut_pieces(1) == [(0, 1)] and P.cut_pieces(2048) == [(0, 2048)]
    assert P.cut_pieces(2049) == [(0, 1), (1, 2048)] and P.cut_pieces(4096) == [(0, 2048), (2048, 2048)]


TRICKY = ["", " ", "\n", "a  b\n\n c", "it's  don't 'x\"", "é  ñ　x", "x\ty  ", "½ 12ab__c-- d", "😀 hi <|endoftext|>", "hi <|endoftext|> x", "<|endoftext|><|endoftext|>", "a <|endoftext", "end ", "\n a", "a b \x1c c", "'s", "  \n  x", "１２ Ⅷ ª"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab 1.'é\n\t½_　", max_size=20), max_size=5))
def test_tokens_are_those_of_the_tokenizer(more):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    texts = TRICKY + more
    found = tokenizer()(texts)
    assert [x.tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_and_colliding_hashes():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    own = P.PieceCachedTokenizer(P.tokenizer_path())
    assert own(["hi <|endoftext|> x"])[0].tolist() == [5303, 220, 50256, 2124]
    texts = ["some words here", "other words", "it's"]
    own(texts)
    own.second[:3] += np.uint64(1)  # as if these pieces were others with the same first hash
    assert [x.tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, data):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    found = {}
    for r in P.op2_best_fit_packing(spark, data).collect():
        found.setdefault(r["doc_id"], []).append(r)
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert set(found) == {r["doc_id"] for r in rows}
    bins = {}
    for row in rows:
        ids = [*plain.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(found[row["doc_id"]], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == P.cut_pieces(len(ids))
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048


def tokenizer(kept={}):  # noqa: B006
    return kept.setdefault(0, P.PieceCachedTokenizer(P.tokenizer_path(), limit=50))


def test_documents(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.tokenizer_path())
    texts = [None, "", "hi <|endoftext|> x", "word " * 5000, "a b c " * 700] + ["same text"] * 7 + [f"text {k} " * k for k in range(60)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, piece string, offset int").repartition(3)
    rows = P.pack_documents(docs).collect()
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    bins, pieces = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: [(i, *p) for i, p in enumerate(P.cut_pieces(len(v)))] for k, v in ids.items()} == {k: sorted(v) for k, v in pieces.items()}
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_repeated_and_empty_and_bad_pieces(spark):
    rows = spark.createDataFrame([(1, 0, 10, 5)] * 6, "doc_id long, piece int, length long, sequence_id int")
    found = P.pack(rows, 30, buckets=3).collect()
    assert sorted((r["sequence_id"], r["offset"]) for r in found) == [(0, 0), (0, 10), (0, 20), (1, 0), (1, 10), (1, 20)]
    assert P.pack(rows.limit(0), 30).collect() == []
    with pytest.raises(ValueError):
        P.pack(rows, 5)
