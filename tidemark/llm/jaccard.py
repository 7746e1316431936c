"""N-gram Jaccard self-join by MinHash banding, with exact verification on full n-gram sets.

1. One pass over the texts gives 128 bits that tell the sequence of words, and band hashes. Texts with the same words
   become one class by partial aggregation; only its smallest id goes on.
2. Band hashes are shuffled; every member of a band bucket is tied to the bucket's smallest id (a star: linear in the
   bucket). Components of these ties are sets of candidates: texts of different sets share no bucket.
3. Texts of candidates are read again, their full n-gram sets go to their candidate set's task. A large set is cut into
   chunks and every pair of chunks is a task of bounded size. A task compares by matrix products of incidence blocks
   and returns one row per text (links, smallest linked id): pairs are never rows.
4. Components of the verified links are the classes of near duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.memory import lean
from tidemark.llm.store import stored
from tidemark.llm.textops import U64, buffers, mix, sequence_ids, shingles, word_hashes, words

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 6
SLICE = 4 << 20


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows so that a pair at ``similarity`` shares a bucket with probability ``recall`` or more."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    _, off = buffers(batch.column(column))
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(off, off[k] + most, side="right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop


def minhash_bands(found: np.ndarray, ptr: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """(documents, bands) of 64-bit bucket hashes; zero for a document without shingles."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | U64(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    out = np.zeros((len(ptr) - 1, bands), U64)
    full = np.flatnonzero(np.diff(ptr) > 0)
    if not len(full):
        return out
    short = (found >> U64(32)).astype(np.uint32)
    starts = ptr[full]
    step, k = 1 << 15, 0  # documents whose shingles fit into the cache, together
    while k < len(full):
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + step)))
        part = short[starts[k] : ptr[full[stop - 1] + 1]]
        at = starts[k:stop] - starts[k]
        sig = np.empty((bands * rows, len(at)), np.uint32)
        work = np.empty_like(part)
        for j in range(bands * rows):
            np.multiply(part, a[j], out=work)
            np.add(work, b[j], out=work)
            sig[j] = np.minimum.reduceat(work, at)
        key = np.zeros((bands, len(at)), U64)
        with np.errstate(over="ignore"):
            for r in range(rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + sig.reshape(bands, rows, -1)[:, r].astype(U64) + U64(1))
            out[full[k:stop]] = mix(key + (np.arange(bands, dtype=U64) * U64(0xD1B54A32D192ED03))[:, None]).T
        k = stop
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, f1, f2, n_words, buckets) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                low, starts, ends, ptr = words(*buffers(part.column(1)))
                hashes = word_hashes(low, starts, ends)
                f1, f2 = sequence_ids(hashes, ptr)
                keys = minhash_bands(*shingles(hashes, ptr, n), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f1), pa.array(f2), pa.array(np.diff(ptr)), lists], names=["doc_id", "f1", "f2", "n_words", "buckets"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, f1 long, f2 long, n_words long, buckets array<long>")


def shingle_sets(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``keep`` columns with the sorted distinct shingle hashes of text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, part_at):
                low, starts, ends, ptr = words(*buffers(part.column(part_at)))
                found, at = shingles(word_hashes(low, starts, ends), ptr, n)
                sets = [np.unique(found[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:part_at], pa.array(sets, pa.binary())], names=[*keep, "grams"])

    part_at = len(keep)
    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(lean(run), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", grams binary")


def linked(sets: list[np.ndarray], similarity: float, cells: int = 8 << 20) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the limit, by blocks of the incidence matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    gram = np.concatenate(sets) if n else np.zeros(0, U64)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    column = np.cumsum(new) - 1
    held = np.bincount(column)
    shared = held[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
        width = max(1, cells // n)
        bounds = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b > a:
                block = np.zeros((n, width), np.float32)
                block[owner[a:b], column[a:b] - k * width] = 1
                block = block[:, : column[b - 1] - k * width + 1]
                common += block @ block.T
    union = sizes[:, None] + sizes[None, :] - common
    out = (common >= similarity * union - 1e-6) & (union > 0)
    np.fill_diagonal(out, False)
    return out


def verify(sets: DataFrame, similarity: float) -> DataFrame:
    """(rep, links, least) per text and tile; sets has comp, i, j, side, rep, grams, each (comp, i, j) within one partition, sorted."""

    def tile(rows: list[tuple]) -> pa.RecordBatch | None:
        ids = np.array([r[4] for r in rows])
        side = np.array([r[3] for r in rows])
        match = linked([np.frombuffer(r[5], U64) for r in rows], similarity)
        if rows[0][1] != rows[0][2]:  # two chunks: pairs within one are another task's
            match &= side[:, None] != side[None, :]
        n = match.sum(1)
        hit = np.flatnonzero(n)
        if not len(hit):
            return None
        # the smallest id within the tile's own components, so that a task gives a forest and not its pairs
        least = ids.copy()
        while True:
            new = np.array([min(least[k], least[match[k]].min()) if n[k] else least[k] for k in range(len(ids))])
            if (new == least).all():
                break
            least = new
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit].astype(np.int64)), pa.array(least[hit])], names=["rep", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    if len(rows) > 1 and (out := tile(rows)) is not None:
                        yield out
                    key, rows = row[:3], []
                if not rows or rows[-1][4] != row[4]:  # a repeated row is one text
                    rows.append(row)
        if len(rows) > 1 and (out := tile(rows)) is not None:
            yield out

    return sets.mapInArrow(lean(run), "rep long, links long, least long")


def near_duplicates(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, chunk_texts: int = 1000, chunk_grams: int = 1_000_000) -> DataFrame:
    """(doc_id, class_id, text_id, n_copies, n_links) of every row of ``docs`` (doc_id long, text; other columns are ignored).

    class_id: smallest doc_id of those connected by links of ``similarity`` or more on sets of ``n`` words; text_id:
    smallest doc_id of those with the same sequence of words (A-Z as a-z, any white space); n_copies: rows with that
    sequence; n_links: other sequences linked to it directly. A text of 1 to n-1 words is one n-gram. A null text or one
    without words has no n-grams: it is linked to nothing and its own class. Rows that repeat a doc_id come back as often.
    An empty table gives an empty one. A row whose doc_id is null is compared with nothing and has null class_id and
    text_id. Texts of any length are read whole. All pairs of a candidate set are compared, as links are counted: a set of
    m texts is cut into m / ``chunk_texts`` chunks and copied as often, each pair of chunks being a task's work.
    """
    bands = bands_for(similarity, recall, rows)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    nameless = docs.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    docs = docs.filter("doc_id is not null")
    signed = stored(sign(docs, n, bands, rows), "signed")
    some = signed.filter("n_words > 0")
    classes = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("buckets").alias("buckets"), F.first("n_words").alias("n_words"))
    classes = stored(classes, "classes")
    banded = classes.select("rep", F.explode("buckets").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first != last").select("bucket", "first")
    ties = stored(banded.join(buckets, "bucket").filter("rep != first").select(F.col("rep").alias("u"), F.col("first").alias("v")).distinct(), "ties")
    candidates = connected_components(ties)
    sized = candidates.withColumnRenamed("node", "rep").join(classes.select("rep", "n_words"), "rep")
    weight = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / chunk_texts), F.ceil(F.sum("n_words") / chunk_grams)).cast("int").alias("chunks"))
    sized = stored(sized.join(weight, "component").select("rep", "component", "chunks"), "candidates")
    texts = docs.filter("text is not null").join(sized.withColumnRenamed("rep", "doc_id"), "doc_id")
    grams = shingle_sets(texts, n, ["doc_id", "component", "chunks"])
    grams = grams.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = grams.select(F.col("component").alias("comp"), F.least("side", "k").alias("i"), F.greatest("side", "k").alias("j"), "side", F.col("doc_id").alias("rep"), "grams")
    tiles = tiles.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep")
    found = stored(verify(tiles, similarity), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("n_links"))
    joined = connected_components(found.filter("rep != least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    classed = classes.select("f1", "f2", "rep", "n_copies").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classed = classed.select("f1", "f2", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("text_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = some.select("doc_id", "f1", "f2").join(classed, ["f1", "f2"]).select("doc_id", "class_id", "text_id", "n_copies", "n_links")
    empty = signed.filter("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(empty).unionByName(nameless)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class of near duplicates: that with the smallest doc_id, all its columns.

    Here texts without words (null, empty, white space) are copies of each other, so one stays. Rows without a doc_id stay.
    """
    found = near_duplicates(docs, **options)
    kept = found.filter("doc_id = class_id").select("doc_id").distinct()
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    least = docs.filter(blank).agg(F.min("doc_id")).first()[0]
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).filter(~blank | (F.col("doc_id") == F.lit(least)))
    return named.unionByName(docs.filter("doc_id is null"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, translate(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT *, CASE WHEN t = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY t) END AS text_id,
  CASE WHEN t = '' THEN 1 ELSE count(*) OVER (PARTITION BY t) END AS n_copies FROM d),
w AS (SELECT DISTINCT text_id, string_split(t, ' ') AS a FROM r WHERE t <> ''),
g AS (SELECT DISTINCT text_id, unnest(CASE WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
  ELSE list_transform(range(len(a) - 4), lambda i: array_to_string(a[i + 1 : i + 5], ' ')) END) AS gram FROM w),
z AS (SELECT text_id, count(*) AS n FROM g GROUP BY text_id),
c AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS m FROM g x JOIN g y ON x.gram = y.gram AND x.text_id <> y.text_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN z p ON p.text_id = a JOIN z q ON q.text_id = b WHERE m >= 0.8 * (p.n + q.n - m)),
k AS (SELECT text_id AS node, text_id AS root FROM z UNION SELECT l.b, k.root FROM k JOIN l ON l.a = k.node),
s AS (SELECT node, min(root) AS root FROM k GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(root, r.text_id) AS class_id, r.text_id, n_copies::BIGINT AS n_copies, coalesce(n_links, 0)::BIGINT AS n_links
FROM r LEFT JOIN s ON s.node = r.text_id LEFT JOIN n ON n.a = r.text_id
"""
