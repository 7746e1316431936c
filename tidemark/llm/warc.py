"""WARC 1.1 archives: a writer of gzip members and a reader that splits archives by byte range.

Archives live in the shared folder, reached through ``pyarrow.fs`` from the folder's own scheme (file, hdfs, s3, gs);
inputs are read by Spark alone. A writing task writes under a name of its own attempt and then renames, so a task that
runs again after a lost executor leaves one whole archive. A reading task looks for the gzip magic from the start of its
range, decodes the first bytes of a candidate to see whether a WARC header follows, and takes the records that start in
its range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.skew import spread_join
from tidemark.llm.store import cut, new_path, stored

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
STEP, CHUNK = 1 << 20, 1 << 14
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, level: int = 6) -> bytes:
    """One gzip member. A revisit holds the HTTP header only; its Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict | None:
    """The record of one decoded member; None if it isn't one."""
    head, gap, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        return None
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = block[: int(field.get("content-length", len(block)))]
    kind = field.get("warc-type")
    http, payload = None, block
    if field.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in (http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {
        "record_id": field.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": field.get("warc-target-uri"), "payload_digest": field.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": field["warc-refers-to"].strip("<>") if "warc-refers-to" in field else None, "http_length": length, "payload": None if kind == "revisit" else payload,
    }


def write_warc(records: DataFrame, folder: str, roll_bytes: int = 256 << 20) -> DataFrame:
    """Writes (record_id, uri, payload binary, digest, refers_to) as archives in ``folder``: (path, bytes, records).

    Null payloads are empty, a null digest is computed from the payload. Each partition makes one archive, or more of
    about ``roll_bytes``. An empty table makes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, done, out, name, held, n = TaskContext.get().partitionId(), [], None, "", 0, 0

        def close() -> None:
            nonlocal out, held, n
            if out is not None:
                out.close()
                final = f"{root}/part-{part:06d}-{len(done):04d}.warc.gz"
                fs.move(name, final)
                done.append((f"{folder}/part-{part:06d}-{len(done):04d}.warc.gz", held, n))
                out, held, n = None, 0, 0

        for batch in batches:
            for row in (r for k in range(0, batch.num_rows, 200) for r in batch.slice(k, 200).to_pylist()):
                if out is None:
                    name = f"{root}/attempt-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name, compression=None)
                payload = row["payload"] or b""
                data = record_bytes(row["record_id"], row["uri"], payload, row["digest"] or base32_sha1(payload), row["refers_to"])
                out.write(data)
                held, n = held + len(data), n + 1
                if held >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64()), "records": pa.array([x[2] for x in done], pa.int64())})

    return cut(records.select("record_id", "uri", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes long, records long"))


class _Window:
    """Bytes of a file from a position on, read in steps."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(STEP)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.at]
        self.at = to


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, decoded bytes) of the WARC members of a gzip file that start in [start, end)."""
    w = _Window(file, start)
    at = start
    while at < end:
        if at - w.at > STEP:
            w.drop(at)
        found = w.data.find(MAGIC, at - w.at)
        if found < 0:
            at = max(at, w.at + len(w.data) - 2)
            if not w.more():
                return
            continue
        at = w.at + found
        if at >= end:
            return
        unpack, got, used, seen, good = zlib.decompressobj(31), [], found, 0, True
        try:
            while not unpack.eof:
                if used >= len(w.data) and not w.more():
                    good = False
                    break
                chunk = w.data[used : used + CHUNK]
                piece = unpack.decompress(chunk)
                used += len(chunk)
                got.append(piece)
                if seen < 7 and b"".join(got)[:7] != b"WARC/1."[: seen + len(piece)]:
                    good = False
                    break
                seen += len(piece)
        except zlib.error:
            good = False
        if good and seen >= 7:
            yield at, b"".join(got)
            at = w.at + used - len(unpack.unused_data)
        else:
            at += 1


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 8 << 20, task_bytes: int = 256 << 20) -> DataFrame:
    """All records of (path, bytes) archives, by ranges of ``split_bytes``. An empty table gives no record.

    A task reads ranges of about ``task_bytes`` one after the other, fewer where that leaves cores idle. A record is read
    whole however long its payload is (in memory linear in it), by the task that owns its first byte.
    """
    ranges = archives.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
    n, held = ranges.count(), archives.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, min(n, max(3 * spark.sparkContext.defaultParallelism, held // task_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for _, data in members(file, row["start"], row["start"] + split_bytes):
                        record = parse_record(data)
                        if record is not None:
                            rows.append(record)
                            held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(tasks).mapInArrow(run, RECORD)


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) as records: the smallest page_id of equal payloads is the response, others revisit it.

    Payloads under ``least_bytes`` are all responses. A null html is an empty payload; of rows with the same page_id and
    payload, each is a response. Payloads of any length are kept whole; other columns are ignored, whatever their names.
    A payload that very many pages share is no hot key: the join of pages with the first page_ids is spread over salts.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html").withColumn("__sha", digest).withColumn("__n", F.coalesce(F.octet_length("html"), F.lit(0)))
    first = rows.filter(F.col("__n") >= least_bytes).groupBy("__sha", "__n").agg(F.min("page_id").alias("__first"), F.count("*").alias("n"))
    joined = spread_join(rows, stored(first, "payloads"), ["__sha", "__n"], ["page_id", "url"])
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return joined.select(F.coalesce(name("page_id"), F.lit("urn:page:")).alias("record_id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"), F.lit(None).cast("string").alias("digest"), F.when(F.col("page_id") != F.col("__first"), name("__first")).alias("refers_to"))


def op7_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_warc(plan_revisits(pages, 0), new_path(spark, "warc"))
    records = read_warc(spark, archives)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return records.select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(x, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, n) AS first_id FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f
"""
