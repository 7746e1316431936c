"""Best-fit packing by linear grouping.

Lengths are at most the capacity, so all that is optimised is a histogram of at most ``capacity`` counters, whatever the
size of the corpus. Large lengths are rounded up within groups of equal cardinality; column generation finds fractional
numbers of the few-size configurations, which are rounded down; actual documents (at most as long as their rounded
size) take the places; everything left goes best-fit, longest first, into the rest of the open sequences and then
into new ones. Runs of equal bins are handled as ranges, so the plan is a few thousand rows: (length, first rank, last
rank) to (first sequence, offset). Pieces get their rank within their length in two levels (bucket offset plus rank in the bucket),
so that a length that most pieces share is never gathered in one task.
"""

from __future__ import annotations

import bisect
import itertools
import math
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.memory import lean
from tidemark.llm.store import stored
from tidemark.llm.textops import word_hashes

CAPACITY = 2048
# The white space of the vocabulary file's pre-tokenizing pattern.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


class PieceCachedTokenizer:
    """Ids of a byte-level BPE file by ``tokenizers``, for whole batches of texts.

    Merges never cross the pieces of the pre-tokenizing pattern. The pieces of a batch are found and hashed (twice 64 bits)
    by array operations on its code points; each distinct piece goes through the tokenizer once and is kept, up to
    ``limit`` pieces. Texts with an apostrophe (contractions), beyond the basic plane, with the name of a special token or
    with a piece whose two hashes disagree with the kept one go through the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_padding()
        self.encoder.no_truncation()
        self.added = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        (self.feed,) = self.encoder.encode("\n", add_special_tokens=False).ids
        self.limit = limit
        kinds = {"L": 1, "N": 2}
        self.kind = np.array([kinds.get(unicodedata.category(chr(i))[0], 3) for i in range(1 << 16)], np.uint8)
        self.kind[WHITE_SPACE] = 0
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.bounds, self.second = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint64)

    def _learn(self, keys: list[int], second: np.ndarray, pieces: list[str]) -> None:
        """Encodes new pieces: many at a time, parted by line feeds (a token of its own); white space one by one."""
        solid = [k for k, p in enumerate(pieces) if not p.isspace()]
        loose = [k for k, p in enumerate(pieces) if p.isspace()]
        flat, sizes = [], []
        for a in range(0, len(solid), 6400):
            part = solid[a : a + 6400]
            texts = ["\n".join(pieces[k] for k in part[i : i + 64]) + "\n" for i in range(0, len(part), 64)]
            ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != len(part):
                raise ValueError("a piece holds a line feed")
            flat.append(ids[ids != self.feed])
            sizes.append(np.diff(feeds, prepend=-1) - 1)
        for k in loose:
            ids = np.array(self.encoder.encode(pieces[k], add_special_tokens=False).ids, np.uint32)
            flat.append(ids)
            sizes.append(np.array([len(ids)]))
        self.slot.update(zip([keys[k] for k in solid + loose], range(len(self.slot), len(self.slot) + len(keys)), strict=True))
        self.second = np.concatenate([self.second, second[solid + loose]])
        self.flat = np.concatenate([self.flat, *flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """One array of uint32 ids per text."""
        if len(self.slot) > self.limit:
            self._clear()
        sizes = np.array([len(t) for t in texts], np.int64)
        plain = np.array(["'" not in t and not any(x in t for x in self.added) for t in texts], bool)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) and points.max() > 0xFFFF:
            plain[np.searchsorted(np.cumsum(sizes), np.flatnonzero(points > 0xFFFF), side="right")] = False
        hard = np.flatnonzero(~plain).tolist()
        easy = "".join(t for t, p in zip(texts, plain.tolist(), strict=True) if p)
        edges = np.concatenate([[0], np.cumsum(sizes[plain])])
        points = points[np.repeat(plain, sizes)] if hard else points
        starts = self._starts(points, edges)
        stops = np.append(starts[1:], len(points)).astype(np.int64)
        hashes, second = word_hashes(points, starts, stops), word_hashes(points * np.uint32(2654435769), starts, stops)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(easy))
        known = self.slot
        fresh = [k for k, h in enumerate(unique.tolist()) if h not in known]
        if fresh:
            self._learn(unique[fresh].tolist(), second[at[fresh]], [easy[starts[j] : ends[j]] for j in at[fresh].tolist()])
        slots = np.fromiter((known[h] for h in unique.tolist()), np.int64, len(unique))[inverse]
        first, count = self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, edges)]
        out: list = [None] * len(texts)
        for i, a, b in zip(np.flatnonzero(plain).tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        doubted = np.flatnonzero(self.second[slots] != second)  # another piece has the same first hash
        if len(doubted):
            hard += np.flatnonzero(plain)[np.unique(np.searchsorted(edges, starts[doubted], side="right") - 1)].tolist()
        for i in hard:
            out[i] = np.array(self.encoder.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _starts(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[points]
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        space, blank = kind == 0, points == 32
        start = edge[:-1].copy()
        before, now = kind[:-1], kind[1:]
        inner = np.where(now != 0, (before != now) & ~blank[:-1], before != 0)
        start[1:] |= inner
        run_end = space[1:-1] & space[:-2] & ~space[2:] & ~edge[2:-1] if n > 2 else np.zeros(0, bool)
        start[1 : 1 + len(run_end)] |= run_end
        return np.flatnonzero(start)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


_tokenizers: dict[str, PieceCachedTokenizer] = {}


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; a null text is empty: its one id 0.

    A very long text is tokenized whole and gives as many pieces as it needs. Repeated rows give repeated pieces, an empty
    table none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = path or tokenizer_path()
        encode = _tokenizers.get(name) or _tokenizers.setdefault(name, PieceCachedTokenizer(name))  # kept while the worker lives
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = ids.astype("<u4").tobytes() + b"\0\0\0\0"
                    for i, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, i, start, length, zlib.crc32(own), own if with_ids else None))
                columns = list(zip(*rows, strict=True))
                types = (part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(columns, types, strict=True))[: 5 + with_ids]], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over the few sizes (by dynamic programming over the capacity)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [k for k in np.argsort(sizes) if values[k] > 1e-12 and most[k] > 0]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        for k in order:
            if sizes[k] > c:
                break
            if best[c - sizes[k]] + values[k] > best[c] + 1e-12:
                best[c], take[c] = best[c - sizes[k]] + values[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
    return best[capacity], pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 80) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of configurations (size: how many) that serve at most the demand; by column generation, rounded down."""
    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // s).astype(float))
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(s)))
        value, pattern = _best_pattern(s, dual, d, capacity)
        if value <= 1 + 1e-7:
            break
        level, step = np.linalg.solve(basis, d), np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(level, 0) / np.where(step > 1e-9, step, 1), np.inf)
        k = int(np.argmin(ratio))
        if not np.isfinite(ratio[k]):
            break
        basis[:, k] = pattern
    out, left = [], d.copy()
    for column, x in zip(basis.T, np.linalg.solve(basis, d), strict=True):
        n = int(max(0, np.floor(x + 1e-9)))
        used = column > 0
        n = min(n, int(np.min(left[used] // column[used]))) if used.any() else 0
        if n > 0:
            left -= n * column
            out.append(({int(z): int(c) for z, c in zip(s, column, strict=True) if c}, n))
    return out


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 64, large: float = 0.4) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan as (length, first rank, rank after the last, first sequence, offset), and the number of sequences.

    Item r of a segment goes to sequence ``first sequence + (r - first rank)``.
    """
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    rank: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: ranges of sequences; filled up to capacity - room
    rooms: list[int] = []
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, rank[length], rank[length] + n, first, offset))
        rank[length] += n
        left[length] -= n

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not open_bins[room]:
                bisect.insort(rooms, room)
            open_bins[room].append((first, n))

    big = sorted((k for k in left if large * capacity < k < capacity), reverse=True)
    total = sum(left[k] for k in big)
    if total:
        share, members, sizes = -(-total // groups), [], []
        held = 0
        for k in big:  # equal cardinality; a length stays whole, so that the histogram keeps its form
            if not members or held >= share:
                members.append([])
                sizes.append(k)
                held = 0
            members[-1].append(k)
            held += left[k]
        group = dict(zip(sizes, members, strict=True))
        for pattern, n in configurations(sizes, [sum(left[k] for k in m) for m in members], capacity):
            runs = [(0, n, bins)]  # (filled, how many, first): split as lengths of a group run out
            bins += n
            for size, times in sorted(pattern.items(), reverse=True):
                for _ in range(times):
                    after = []
                    for filled, m, first in runs:
                        while m:
                            length = next(k for k in group[size] if left[k])
                            take = min(m, left[length])
                            put(length, take, first, filled)
                            after.append((filled + length, take, first))
                            first, m = first + take, m - take
                    runs = after
            for filled, m, first in runs:
                leave(capacity - filled, first, m)
    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_bins[room].pop()
                take = min(n, left[length])
                if take < n:
                    open_bins[room].append((first + take, n - take))
                if not open_bins[room]:
                    rooms.pop(at)
                put(length, take, first, capacity - room)
                leave(room - length, first, take)
            else:
                each = capacity // length
                n = left[length] // each
                if not n:
                    n, each = 1, left[length]
                for j in range(each):
                    put(length, n, bins, j * length)
                leave(capacity - each * length, bins, n)
                bins += n
    return plan, bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None, **options) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; ``pieces`` should be cheap to read again.

    Rows of equal doc_id and piece are different pieces. A length outside 1..capacity is an error. An empty table gives
    an empty one; columns sequence_id and offset of the input are replaced. Ranks are taken in ``buckets`` (an eighth of
    the root of the number of pieces), by column __salt if there is one (it is not returned), else by doc_id and piece.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salt = [F.col("__salt")] if "__salt" in pieces.columns else [F.col("doc_id"), F.col("piece")]
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(k is None or not 0 < k <= capacity for k in counts):
        raise ValueError("a piece has no length within the capacity")
    plan, _ = pack_histogram(counts, capacity, **options)
    buckets = buckets or 1 + math.isqrt(sum(counts.values())) // 8
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64(*salt), F.lit(buckets)))
    sizes = dealt.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = sizes.select("length", "__b", (F.sum("__n").over(Window.partitionBy("length").orderBy("__b")) - F.col("__n")).alias("__before"))
    own = Window.partitionBy("length", "__b").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("__own", F.row_number().over(own) - 1).join(before, ["length", "__b"])
    ranked = ranked.withColumn("__r", F.col("__before") + F.col("__own"))
    # The plan grows with capacity and groups, not with the corpus; looked up in an array per length, so no row is multiplied.
    # As an Arrow table it needs no Python workers on the executors, which would wait there beside those of the texts.
    columns = np.array(plan, np.int64).reshape(-1, 5).T
    rows = spark.createDataFrame(pa.table(list(columns), names=["length", "r0", "r1", "bin0", "place"]))
    segments = F.broadcast(rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("r0", "bin0", "place"))).alias("__seg")))
    found = ranked.join(segments, "length").withColumn("__s", F.expr("element_at(filter(__seg, s -> s.r0 <= __r), -1)"))
    return found.select(*[c for c in pieces.columns if c != "__salt"], (F.col("__s.bin0") + F.col("__r") - F.col("__s.r0")).alias("sequence_id"), F.col("__s.place").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs all documents (see :func:`token_pieces` and :func:`pack`)."""
    pieces = token_pieces(docs, capacity, path, with_ids).withColumn("__salt", F.monotonically_increasing_id())  # written, so fixed
    return pack(stored(pieces, "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
