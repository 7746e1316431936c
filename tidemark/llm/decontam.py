"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The random walk of Chakraborty, Goldenberg and Koucky maps strings at small edit distance to strings at small Hamming
distance. The index holds, for every hash, the walks that begin at each word of an item; a document's windows begin at
every ``STRIDE``-th word, so that some begin where a walk of the item does. A window reaches as far as the item; its hashes
sample the walk's first ``STEPS`` places, so edits further on don't move them. The number of hashes follows from the target
recall, the share of places at which a window and its item may differ and the windows an item has at least. A window that
shares a hash with an item is verified: the exact edit distance (bit-parallel) of the whole item to the nearest substring
around the place that the two beginnings tell.

Items too short for that have windows at every word, with shorter walks; items under fifteen characters are found where their
words occur unchanged. Texts are lower-cased (A-Z), white space is one blank and x00 counts as x01. Items are held in every task, in
blocks of at most ``block_bytes`` (their index is about seventy times as large); each further block hashes the documents again.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import slices
from tidemark.llm.memory import lean
from tidemark.llm.textops import U64, blanks, buffers, mix, word_hashes, words

MAX_EDITS, RECALL = 0.2, 0.99
WALKS, SAMPLED = 4, 12
#: Share of the sampled part of the walk at which a window and its item may differ, and the windows that an item has at least.
HAMMING, WINDOWS = 0.27, 2
#: (steps, places a hash samples, words from window to window) for long and for short items.
LONG, SHORT = (64, SAMPLED, 3), (24, SAMPLED, 1)
#: Bytes of text that a task looks at together.
SLICE = 1 << 20
#: Starts within so many characters tell the same place.
GRAIN = 16


def hashes_for(recall: float, hamming: float, sampled: int, windows: int = 1) -> int:
    """Bit-sampling hashes so that of ``windows`` pairs that differ at a share ``hamming`` of places one collides at least once with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - hamming) ** sampled) / windows))


def cgk(texts: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The walk of each row of a matrix of bytes (zero beyond its end): a row of ``steps`` bytes each."""
    move = np.random.default_rng(seed).integers(1, 256, steps, dtype=np.uint8)
    data = np.append(np.pad(texts, ((0, 0), (0, 1))).ravel(), 0).astype(np.uint8)
    at, out = np.arange(len(texts)) * (texts.shape[1] + 1), np.empty((steps, len(texts)), np.uint8)
    for j in range(steps):
        out[j] = data[at]
        at += (out[j] * move[j]) >> np.uint8(7)
    return out.T


def edit_distance_within(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any substring of ``text`` and where that substring ends; (most + 1, -1) beyond."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # the text may start anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else (most + 1, -1)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").replace(b"\0", b"\1").lower().split())


def run_hashes(found: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k-1 are no runs)."""
    acc = found.copy()
    padded = np.concatenate([found, np.zeros(k, U64)])
    with np.errstate(over="ignore"):
        for j in range(1, k):
            acc = acc * U64(0x9E3779B97F4A7C15) + padded[j : j + len(found)]
    return mix(acc + U64(k))


class Texts:
    """Normal texts in one array, each followed by a zero: words begin at ``at``, those of text t are ``ptr[t]`` to ``ptr[t + 1]``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low, starts, ends, self.ptr = words(np.where(raw == 0, np.uint8(1), raw), offsets)
        self.hashes = word_hashes(low, starts, ends)
        n = ends - starts
        self.at = np.concatenate([[0], np.cumsum(n + 1)])[:-1].astype(np.int64)
        self.data = np.full(int((n + 1).sum()), 32, np.uint8)
        inside = np.ones(len(self.data), bool)
        inside[self.at + n] = False
        self.data[inside] = low[~blanks(low)]
        full = np.diff(self.ptr) > 0
        self.end = np.zeros(len(self.ptr) - 1, np.int64)  # the place of each text's zero
        last = self.ptr[1:][full] - 1
        self.end[full] = self.at[last] + n[last]
        self.data[self.end[full]] = 0
        self.text = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))  # of each word


class Sampler:
    """Hashes of walks of ``steps`` places: each samples ``sampled`` places of the walk of one of WALKS random functions.

    A walk's hashes are the pairs of half hashes of ``sampled`` / 2 places, so there are at least ``hashes``.
    """

    def __init__(self, steps: int, sampled: int, hashes: int, seed: int):
        rng = np.random.default_rng(seed)
        halves = next(m for m in range(2, hashes + 3) if WALKS * m * (m - 1) // 2 >= hashes)
        self.steps, self.plans = steps, []
        for _ in range(WALKS):
            move = rng.integers(1, 256, steps, dtype=np.uint8)
            taken: list[list[int]] = [[] for _ in range(steps)]
            for h in range(halves):
                for j in rng.choice(steps, sampled // 2, replace=False):
                    taken[j].append(h)
            self.plans.append((move, taken, halves))

    def keys(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(hash, its value for the walk from each place)."""
        number = 0
        for move, taken, halves in self.plans:
            half = [np.full(len(at), h + 1, U64) for h in range(halves)]
            place = at.copy()
            for j in range(self.steps):
                now = data[place]
                for h in taken[j]:
                    half[h] *= U64(257)
                    half[h] += now
                place += (now * move[j]) >> np.uint8(7)  # a random function of the character, 0 at the end of the text
            one, two = [h * U64(0x9E3779B97F4A7C15) for h in half], [h * U64(0xBF58476D1CE4E5B9) for h in half]
            for i, j in itertools.combinations(range(halves), 2):
                yield number, one[i] + two[j]
                number += 1


PLACE, ITEM = 28, 20


def pairs(text, item, place):
    """Text, item and place / GRAIN in one number: slices of texts and blocks of items are small enough."""
    return (np.asarray(text, np.int64) << (PLACE + ITEM)) | (np.asarray(item, np.int64) << PLACE) | (np.maximum(place, 0) // GRAIN)


class Index:
    """Walks from all words of items, of which so much is left that walks seldom pass the item's end."""

    def __init__(self, texts: Texts, members: np.ndarray, kind: tuple[int, int, int], hashes: int):
        steps, sampled, self.stride = kind
        left = texts.end[texts.text] - texts.at
        own = np.flatnonzero(members[texts.text] & (left >= 0.6 * steps))
        self.item, begin = texts.text[own], texts.at[own]
        self.offset = begin - texts.at[texts.ptr[self.item]]
        self.sampler, self.tables = Sampler(steps, sampled, hashes, steps), {}
        self.shift = U64(64 - max(10, math.ceil(math.log2(32 * max(1, len(own))))))  # 32 bits an entry in a bitmap
        for h, key in self.sampler.keys(texts.data, begin):
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << int(64 - self.shift), bool)
            bits[(key >> self.shift).astype(np.int64)] = True
            self.tables[h] = key[order], order.astype(np.int32), np.packbits(bits)

    def candidates(self, texts: Texts) -> Iterator[np.ndarray]:
        """Distinct (text, item, place) numbers (see pairs()) of windows that share a hash with an item; place is where the item would begin."""
        own = np.flatnonzero((np.arange(len(texts.at)) - texts.ptr[texts.text]) % self.stride == 0)
        if not len(own) or not len(self.item):
            return
        begin, text = texts.at[own], texts.text[own]
        for h, key in self.sampler.keys(texts.data, begin):
            known, order, bits = self.tables[h]
            top = (key >> self.shift).astype(np.int64)
            maybe = np.flatnonzero((bits[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1)
            a, b = np.searchsorted(known, key[maybe], side="left"), np.searchsorted(known, key[maybe], side="right")
            n = b - a
            entry = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            window = np.repeat(maybe, n)
            yield np.unique(pairs(text[window], self.item[entry], begin[window] - self.offset[entry]))


class Items:
    """A block of benchmark items and their index."""

    def __init__(self, rows: list[tuple[int, str | None]], max_edits: float, recall: float):
        self.rows = [(i, t) for i, t in ((i, normal(t)) for i, t in rows) if t]
        self.max_edits = max_edits
        raw = np.frombuffer(b"".join(t + b" " for _, t in self.rows), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in self.rows])]).astype(np.int64)
        texts = Texts(raw, off)
        left = texts.end[texts.text] - texts.at
        starts = lambda kind: np.bincount(texts.text[left >= 0.6 * kind[0]], minlength=len(self.rows))
        long = starts(LONG) >= WINDOWS * LONG[2]
        short = ~long & (starts(SHORT) > 0)
        # Blocks of at most 64 characters of each item, with the places of every character in them.
        self.parts, cut = [], []
        for _, t in self.rows:
            n = -(-len(t) // 64)
            edges = [len(t) * k // n for k in range(n + 1)]
            self.parts.append(range(len(cut), len(cut) + n))
            cut += [(t[x:y], x) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        self.length = np.array([len(x) for x, _ in cut], np.int64)
        self.begin = np.array([x for _, x in cut], np.int64)
        self.places = np.zeros((len(cut), 256), U64)
        for k, (x, _) in enumerate(cut):
            np.bitwise_or.at(self.places[k], np.frombuffer(x, np.uint8), U64(1) << np.arange(len(x), dtype=U64))
        self.indexes = [Index(texts, own, kind, hashes_for(recall, HAMMING, kind[1], n)) for own, kind, n in ((long, LONG, WINDOWS), (short, SHORT, 1)) if own.any()]
        self.tiny: dict[int, dict[int, list[int]]] = {}  # words: hash of the run: items
        for t in np.flatnonzero(~long & ~short).tolist():
            k = int(texts.ptr[t + 1] - texts.ptr[t])
            key = int(run_hashes(texts.hashes[texts.ptr[t] : texts.ptr[t + 1]], k)[0])
            self.tiny.setdefault(k, {}).setdefault(key, []).append(t)

    def candidates(self, texts: Texts) -> np.ndarray:
        """Distinct pairs(), in order."""
        found = [c for index in self.indexes for c in index.candidates(texts)]
        for k, table in self.tiny.items():
            runs = run_hashes(texts.hashes, k)
            for w in np.flatnonzero(np.isin(runs, np.array(list(table), U64))).tolist():
                if w + k <= texts.ptr[texts.text[w] + 1]:
                    found += [pairs([texts.text[w]], [t], [texts.at[w]]) for t in table[int(runs[w])]]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def plausible(items: Items, texts: Texts, found: np.ndarray) -> np.ndarray:
    """The pairs() of which some block of the item is near its place within its share of the allowed edits.

    Nothing is lost: an item within e edits that is cut into n blocks has a block within e / n. All blocks are compared at
    once, bit-parallel, one character of the texts at a time.
    """
    keep = np.zeros(len(found), bool)
    for a in range(0, len(found), 4096):
        own = found[a : a + 4096]
        d, t, place = own >> (PLACE + ITEM), (own >> PLACE) & ((1 << ITEM) - 1), own & ((1 << PLACE) - 1)
        n = np.array([len(items.parts[k]) for k in t.tolist()])
        block = np.concatenate([np.arange(p.start, p.stop) for p in (items.parts[k] for k in t.tolist())])
        row = np.repeat(np.arange(len(own)), n)
        most = np.array([int(items.max_edits * len(items.rows[k][1])) for k in t.tolist()])
        low = np.maximum(place[row] * GRAIN + items.begin[block] - most[row] - 2, texts.at[texts.ptr[d[row]]])
        high = np.minimum(place[row] * GRAIN + items.begin[block] + items.length[block] + most[row] + GRAIN + 2, texts.end[d[row]])
        top = (items.length[block] - 1).astype(U64)
        pv, mv = np.full(len(block), (1 << 64) - 1, U64), np.zeros(len(block), U64)
        score = items.length[block].copy()
        best = score.copy()
        for j in range(int((high - low).max(initial=0))):
            at = low + j
            c = np.where(at < high, texts.data[np.minimum(at, len(texts.data) - 1)], 0)
            eq = items.places[block, c]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> top) & U64(1)).astype(np.int64)
            score -= ((mh >> top) & U64(1)).astype(np.int64)
            np.minimum(best, score, out=best)
            ph <<= U64(1)
            mh <<= U64(1)
            pv, mv = mh | ~(xv | ph), ph & xv
        near = best <= most[row] // n[row]
        keep[a : a + 4096] = np.logical_or.reduceat(near, np.cumsum(n) - n)
    return found[keep]


def scan(items: Items, ids: list, raw: np.ndarray, off: np.ndarray) -> list[tuple]:
    """(doc, item, start word, edits, similarity) of the best place of each pair of document and item."""
    if not len(raw) or not items.rows:
        return []
    texts = Texts(raw, off)
    out: dict[tuple[int, int], tuple] = {}
    for pair in plausible(items, texts, items.candidates(texts)).tolist():
        d, t, place = pair >> (PLACE + ITEM), (pair >> PLACE) & ((1 << ITEM) - 1), pair & ((1 << PLACE) - 1)
        best = out.get((d, t))
        if best and not best[1]:
            continue
        text = items.rows[t][1]
        most = int(items.max_edits * len(text))
        first, end = int(texts.at[texts.ptr[d]]), int(texts.end[d])
        a, b = max(first, place * GRAIN - most - 2), min(end, (place + 1) * GRAIN + len(text) + most + 2)
        area = texts.data[a:b].tobytes() if b > a else b""
        where = area.find(text)
        edits, at = (0, a + where) if where >= 0 else (edit_distance_within(text, area, most)[0], max(first, place * GRAIN))
        if edits <= most and (not best or edits < best[1]):
            word = int(np.searchsorted(texts.at, at, side="right")) - 1 - int(texts.ptr[d])
            out[d, t] = (word, edits, 1 - edits / len(text))
    return [(ids[d], items.rows[t][0], *v) for (d, t), v in sorted(out.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id").toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1])
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL, block_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, start_word, edits, similarity): items that a document holds within ``max_edits`` of their length.

    One row per pair, its place of fewest edits; edits are those to the nearest substring there. Null and empty texts and
    items match nothing; a very long text is read whole; repeated rows give repeated matches, a null doc_id a match with
    a null; an empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, edits long, similarity double"
    out = None
    for block in item_blocks(benchmark, block_bytes):
        items = spark.sparkContext.broadcast(Items(block, max_edits, recall))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1, SLICE):
                    rows = scan(items.value, part.column(0).to_pylist(), *buffers(part.column(1)))
                    if rows:
                        c = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c[0], part.schema.field(0).type), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64())], names=["doc_id", "item_id", "start_word", "edits", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(lean(run), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL, block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; rows are judged where they lie, so nothing is shuffled.

    All columns stay as they are, whatever their names; null and empty texts stay.
    """
    at, out = docs.columns.index("text"), docs
    for block in item_blocks(benchmark, block_bytes):
        items = docs.sparkSession.sparkContext.broadcast(Items(block, max_edits, recall))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at, SLICE):
                    clean = np.ones(part.num_rows, bool)
                    clean[[row[0] for row in scan(items.value, list(range(part.num_rows)), *buffers(part.column(at)))]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(lean(run), docs.schema)
    return out


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("similarity", F.round("similarity", 9))
