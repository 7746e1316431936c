import gzip
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import warc as W
from tidemark.llm.store import new_path

PAGES = [
    (0, "http://a/0", "<p>é</p>"), (1, "http://a/1", "<p>é</p>"), (2, None, None), (3, "http://a/3", ""), (4, "x\r\ny", "long " * 300_000),
    (5, "http://a/5", "WARC/1.1\r\n\r\n\x1f"), (7, "http://a/7", "<p>é</p>"), (7, "http://a/7", "<p>é</p>"), (8, "u", "a\r\n\r\nb"),
]


def brute(pages):
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, u, h in pages:
        data = (h or "").encode()
        f = first[h or ""]
        out.append((i, len(data), W.base32_sha1(data), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=repr)


def trip(spark, pages, **options):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archives = W.write_warc(W.plan_revisits(frame), new_path(spark, "warc"), **options)
    return archives, W.read_warc(spark, archives, 777)


def test_round_trip_by_small_ranges(spark):
    archives, records = trip(spark, PAGES, roll_bytes=400)
    rows = records.collect()
    got = [(int(r["record_id"][9:]), r["http_length"], r["payload_digest"], r["record_type"], int(r["refers_to"][9:]) if r["refers_to"] else None) for r in rows]
    assert sorted(got, key=repr) == brute(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in rows:
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[int(r["record_id"][9:])]
    assert {r["target_uri"] for r in rows} == {"http://a/0", "http://a/1", None, "http://a/3", "x%0D%0Ay", "http://a/5", "http://a/7", "u"}
    assert archives.count() > 2 and archives.agg({"records": "sum"}).first()[0] == len(PAGES)


def test_archives_are_plain_gzip(spark):
    archives, _ = trip(spark, PAGES[:4])
    for r in archives.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            data = gzip.decompress(f.read())
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC/1.1\r\n") == r["records"]


def test_empty_table(spark):
    _, records = trip(spark, [])
    assert records.collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6), st.integers(1, 400))
def test_every_record_has_one_owner(payloads, split):
    records = [W.record_bytes(f"urn:{k}", "u", p + W.MAGIC * 3, "x", None, level=0) for k, p in enumerate(payloads)]  # stored blocks hold false magic
    data = b"junk\x1f\x8b\x08junk" + b"".join(records)
    found = [at for start in range(0, len(data), split) for at, _ in W.members(io.BytesIO(data), start, start + split)]
    assert found == [11 + sum(map(len, records[:k])) for k in range(len(records))]


def test_cut_archive():
    data = W.record_bytes("a", "u", b"one", "x", None) + W.record_bytes("b", "u", b"two", "x", None)[:-5]
    assert len(list(W.members(io.BytesIO(data), 0, len(data)))) == 1


def test_query(spark, data):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in W.op7_warc_roundtrip(spark, data).collect()), key=repr) == brute(pages)
