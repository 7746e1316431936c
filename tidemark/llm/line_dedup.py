"""Line dedup: a sharded minimal perfect hash over line hashes, probed by documents.

One pass counts the documents of every line key (128-bit hash, partial sums per Arrow slice, one small shuffle). Keys in
two or more documents go to shards; each shard is built by one bounded task into three arrays: a minimal perfect hash
(levels of bits), 64-bit fingerprints and counts. A key in one document cannot reach a threshold of two or more, and the
fingerprint refuses it. A second pass over the documents probes the arrays; the texts are not shuffled.

The arrays are broadcast while their measured size is within ``broadcast_bytes``. Beyond that, line hashes meet the
shards in salted co-groups of bounded size, and the lines that go are joined with their texts by a key of the whole row.
Keys whose first 64 bits collide are kept beside the perfect hash, by 128 bits.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.memory import lean
from tidemark.llm.store import stored
from tidemark.llm.textops import U64, mix

BLANK = b" \t\n\x0b\x0c\r"
ARRAYS = ("mph", "prints", "counts", "extra")
GAMMA = 2.0
LEVELS = 24


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: per level one bit array; keys alone at their bit stop there."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            at = cls._place(left, len(levels), max(8, int(GAMMA * len(left))))
            alone = np.bincount(at, minlength=max(8, int(GAMMA * len(left)))) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + U64(level + 1) * U64(0xD6E8FEB86659FD93)) % U64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot."""
        out = np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._place(keys[todo], level, len(bits))
            hit = bits[at] == 1
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            out[todo] = self.base + np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, rest=self.rest, sizes=np.array([len(x) for x in self.levels], np.int64), **{f"l{i}": np.packbits(x) for i, x in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        with np.load(io.BytesIO(data)) as z:
            return cls([np.unpackbits(z[f"l{i}"])[:n] for i, n in enumerate(z["sizes"])], z["rest"])


EXTRA = np.dtype([("h1", U64), ("h2", U64), ("n", np.int32)])


class Shard:
    def __init__(self, mph: bytes, prints: bytes, counts: bytes, extra: bytes):
        self.mph, self.prints, self.counts = PerfectHash.load(mph), np.frombuffer(prints, U64), np.frombuffer(counts, np.int32)
        self.extra = np.frombuffer(extra, EXTRA)

    @staticmethod
    def arrays(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
        """What a shard of these distinct (h1, h2) keys is made of; all but the first key of one h1 go beside the hash."""
        order = np.lexsort((h2, h1))
        h1, h2, n = h1[order], h2[order], np.minimum(n[order], np.iinfo(np.int32).max).astype(np.int32)
        first = np.concatenate([[True], h1[1:] != h1[:-1]])[: len(h1)]
        extra = np.zeros(int((~first).sum()), EXTRA)
        extra["h1"], extra["h2"], extra["n"] = h1[~first], h2[~first], n[~first]
        h1, h2, n = h1[first], h2[first], n[first]
        mph = PerfectHash.build(h1)
        slot = mph(h1)
        prints, counts = np.zeros(len(h1), U64), np.zeros(len(h1), np.int32)
        prints[slot], counts[slot] = h2, n
        return mph.dump(), prints.tobytes(), counts.tobytes(), extra.tobytes()

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 for a key that isn't here."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64)
        slot = np.minimum(self.mph(h1), len(self.prints) - 1)
        out = np.where(self.prints[slot] == h2, self.counts[slot], 0)
        for a, b, n in self.extra.tolist():  # almost always none
            out[(h1 == a) & (h2 == b)] = n
        return out


def shard_of(h1: np.ndarray, n: int) -> np.ndarray:
    return ((h1 >> U64(32)) % U64(n)).astype(np.int64)


def split_lines(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and their digests (16 bytes; none for a key under ``min_chars`` code points)."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [x.strip(BLANK).lower() for x in lines]
    enough = (lambda k: len(k) > 0) if min_chars <= 1 else (lambda k: len(k) >= min_chars and len(k.decode("utf-8", "surrogatepass")) >= min_chars)
    return lines, [xxhash.xxh3_128_digest(k) if enough(k) else b"" for k in keys]


def _counts(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"h1": h[:, 0], "h2": h[:, 1], "n": np.fromiter(found.values(), np.int64, len(found))})

    for batch in batches:
        for text in batch.column(0):
            found.update({k for k in split_lines(text.as_py(), min_chars)[1] if k})
            if len(found) >= 200_000:
                yield out()
                found.clear()
    if found:
        yield out()


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): the number of document rows that hold each line key."""
    part = docs.select(text_col).mapInArrow(lean(lambda it: _counts(it, min_chars)), "h1 long, h2 long, n long")
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, least: int = 2, shard_keys: int = 200_000) -> tuple[DataFrame, int, int]:
    """Shards of the keys in ``least`` or more documents, their number and their bytes."""
    kept = stored(counts.filter(F.col("n") >= max(2, least)), "lines")
    shards = max(1, -(-kept.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = Shard.arrays(pdf["h1"].to_numpy(np.int64).view(U64), pdf["h2"].to_numpy(np.int64).view(U64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame([dict(zip(("shard", *ARRAYS), (int(pdf["shard"].iloc[0]), *arrays), strict=True))])

    keyed = kept.withColumn("shard", F.expr(f"pmod(shiftrightunsigned(h1, 32), {shards})"))
    index = stored(keyed.groupBy("shard").applyInPandas(build, "shard long, " + ", ".join(f"{a} binary" for a in ARRAYS)), "index")
    size = index.agg(F.sum(sum((F.length(a) for a in ARRAYS), F.lit(0).cast("long")))).first()[0] or 0
    return index, shards, size


def _kept(text: str | None, min_docs: int, min_chars: int, look) -> tuple[str, int, int]:
    lines, keys = split_lines(text, min_chars)
    held = [i for i, k in enumerate(keys) if k]
    if not held:
        return text or "", len(lines), 0
    h = np.frombuffer(b"".join(keys[i] for i in held), U64).reshape(-1, 2)
    gone = {i for i, n in zip(held, look(h[:, 0], h[:, 1]), strict=True) if n >= min_docs}
    if not gone:
        return text or "", len(lines), 0
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass"), len(lines), len(gone)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the lines whose key is in ``min_docs`` document rows or more, with n_lines (before) and n_dropped.

    A line's key is the line without x20 and x09-x0D at its ends, A-Z lower-cased; keys under ``min_chars`` code points
    are never dropped. Null and empty texts are one empty line and come back empty. Rows of equal content count each.
    Columns n_lines and n_dropped of the input are replaced; every other column stays. An empty table gives an empty one.
    ``min_docs`` below 2 counts as 1: every line with a key goes.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    schema = StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema] + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    at = docs.columns.index(text_col)
    if min_docs < 2:
        shards, size, index = 1, 0, None
    else:
        index, shards, size = build_index(line_counts(docs, text_col, min_chars))
    if size > broadcast_bytes:
        return _by_shards(docs, index, shards, text_col, min_docs, min_chars, schema)
    arrays = spark.sparkContext.broadcast({r["shard"]: tuple(bytes(r[a]) for a in ARRAYS) for r in index.toLocalIterator()} if index is not None else None)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Shard(*v) for k, v in (arrays.value or {}).items()}

        def look(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            if arrays.value is None:
                return np.ones(len(h1), np.int64)
            out, shard = np.zeros(len(h1), np.int64), shard_of(h1, shards)
            for s in np.unique(shard):
                if s in loaded:
                    own = shard == s
                    out[own] = loaded[s].count(h1[own], h2[own])
            return out

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = [_kept(t.as_py(), min_docs, min_chars, look) for t in part.column(at)]
                columns = list(part.columns)
                columns[at] = pa.array([r[0] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=schema.names)

    return docs.mapInArrow(lean(probe), schema)


def _by_shards(docs: DataFrame, index: DataFrame, shards: int, text_col: str, min_docs: int, min_chars: int, schema: StructType) -> DataFrame:
    """The way without a broadcast: distinct line hashes of each row meet their shard in salted co-groups.

    Rows are told apart by 128 bits of all their columns, so copies of a text under other ids are no hot key.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                found = [{y for y in split_lines(t, min_chars)[1] if y} for t in part.column(2).to_pylist()]
                n = np.array([len(x) for x in found], np.int64)
                h = np.frombuffer(b"".join(y for x in found for y in x), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"c1": np.repeat(part.column(0).to_numpy(), n), "c2": np.repeat(part.column(1).to_numpy(), n), "shard": shard_of(h[:, 0].view(U64), shards), "h1": h[:, 0], "h2": h[:, 1]})

    own = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumn("__c1", F.xxhash64(*own)).withColumn("__c2", F.xxhash64(F.lit(1), *own))
    lines = stored(keyed.select("__c1", "__c2", text_col).mapInArrow(lean(emit), "c1 long, c2 long, shard long, h1 long, h2 long"), "probes")
    # A line that many texts share puts their probes into one shard: each shard gets as many salts as its probes need.
    salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / 500_000).cast("long").alias("salts"))  # a row per shard
    lines = lines.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.col("c1"), F.col("salts"))).drop("salts")
    spread = index.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def probe(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(probes):
            return probes[["c1", "c2", "h1", "h2"]].iloc[:0]
        own = Shard(*(bytes(shard[a][0]) for a in ARRAYS))
        n = own.count(probes["h1"].to_numpy(np.int64).view(U64), probes["h2"].to_numpy(np.int64).view(U64))
        return probes.loc[n >= min_docs, ["c1", "c2", "h1", "h2"]]

    gone = lines.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, "c1 long, c2 long, h1 long, h2 long")
    gone = gone.groupBy(F.col("c1").alias("__c1"), F.col("c2").alias("__c2")).agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))  # lines of one row
    joined = keyed.join(gone, ["__c1", "__c2"], "left").select(*docs.columns, "__gone")
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                rows = []
                for text, drop in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    held = {(x["h1"], x["h2"]) for x in drop or ()}
                    look = lambda h1, h2, held=held: np.array([min_docs if (a, b) in held else 0 for a, b in zip(h1.view(np.int64).tolist(), h2.view(np.int64).tolist(), strict=True)])
                    rows.append(_kept(text, min_docs, min_chars, look))
                columns = list(part.columns)[:-1]
                columns[at] = pa.array([r[0] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=schema.names)

    return joined.mapInArrow(lean(apply), schema)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, r, unnest(a) AS line, unnest(range(len(a))) AS i FROM l),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, r
"""
