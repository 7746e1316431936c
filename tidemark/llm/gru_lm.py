"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, whole documents.

Counts of all words come from the whole corpus by one aggregation. The model's vocabulary is the most frequent training
words, the end and one entry for all rarer words; a rare word has the probability of that entry times its smoothed share
of the rare mass, so every text has a probability. Output biases start at the corpus's unigram frequencies; the network
is trained on all training documents in rounds, at every size alike: each task starts from the round's weights, learns
from its own documents and the weights of all tasks are averaged by words in the tasks. The number of tasks grows with the
words, so a task's work does not. For learning, a document is cut into segments of ``SEGMENT`` words, so that lanes end
together; the state goes on from window to window within a segment. Documents are scored whole, in lanes that advance in
step: a lane's state is carried from window to window and cleared where its next document begins.

Counts of the ``frequent`` words (a fixed number, by all rows, so that a word which only held-out texts hold is there too)
go to every task; rarer words of each document are joined with the table of counts by their hash and summed, so no table
that grows with the corpus is broadcast and no hash is hot.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jaccard import slices
from tidemark.llm.langid import held_out
from tidemark.llm.store import stored
from tidemark.llm.textops import U64, buffers, word_hashes, words

#: Hash that stands for the end of a text in tables of counts (no word has it but by chance).
END_HASH = 0x0E0D
END, RARE = 0, 1
SMOOTH = 0.1
HIDDEN, WINDOW, LANES, CLASSES = 24, 32, 256, 32
#: Lanes and the longest run of words in learning; a step sees LEARN_LANES * WINDOW words.
LEARN_LANES, SEGMENT = 256, 1024
LEADING = 18
SPREAD = 16
#: Logits of less have exponentials, and sums of them, within single precision.
SMALL = 60.0
#: Rounds of averaging in a single pass over the documents; about so many words of a pass and bytes of text a task learns from.
ROUNDS, TASK_WORDS, LEARN_BYTES = 4, 1 << 21, 4 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``; tanh takes less time than exp and a division, and does not overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def class_edges(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where classes of words begin (and the end): the first two words are one class, the others have like sums of root counts."""
    n = len(counts)
    if n <= 2:
        return np.array([0, n])
    mass = np.cumsum(np.sqrt(counts[2:] + 0.5))
    cuts = 2 + np.searchsorted(mass, mass[-1] * np.arange(1, classes - 1) / max(1, classes - 1))
    return np.unique(np.concatenate([[0, 2], cuts[cuts < n], [n]]))


class GRU:
    """Words are numbered by falling frequency after the end and the entry for rarer words; a class is a run of numbers."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 3):
        n = len(counts)
        self.edges = class_edges(counts, classes)
        self.classes = len(self.edges) - 1
        self.kind = np.repeat(np.arange(self.classes), np.diff(self.edges)).astype(np.int16)
        rng = np.random.default_rng(seed)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        share = (counts + 0.5) / (counts + 0.5).sum()
        box = np.add.reduceat(share, self.edges[:-1])
        first = {
            "wx": f(n, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "u": f(hidden, 3 * hidden),
            "wc": f(hidden, self.classes) * 0.1, "bc": np.log(box).astype(np.float32),
            "wo": f(n, hidden) * 0.1, "bo": np.log(share / box[self.kind]).astype(np.float32),
        }
        self.hidden = hidden
        self.shapes = {k: a.shape for k, a in first.items()}
        self.flat = np.concatenate([a.ravel() for a in first.values()]).astype(np.float32)
        self.p = self.parts(self.flat)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of an array as long as all weights, by name."""
        out, at = {}, 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "p"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.p = self.parts(self.flat)

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States after each of the (time, lane) words; keep is 0 where a lane's document begins. ``trace`` takes what the gradient needs.

        Within, arrays are (unit, lane): each gate is one run of memory.
        """
        p, k = self.p, self.hidden
        up, b, h = np.ascontiguousarray(p["u"].T), p["b"][:, None], h.T
        out, gx = np.empty((*x.shape, k), up.dtype), np.empty((3 * k, x.shape[1]), up.dtype)
        for t in range(len(x)):
            h = np.multiply(h, keep[t], order="C")
            gx[:] = p["wx"].take(x[t], 0).T
            gx += b
            gh = up @ h
            zr = sigmoid(gx[: 2 * k] + gh[: 2 * k])
            z, r, inner = zr[:k], zr[k:], gh[2 * k :]
            c = r * inner
            c += gx[2 * k :]
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((h, z, r, c, inner))
            h = h - c
            h *= z
            h += c
            out[t] = h.T
        return out

    def log_probs(self, states: np.ndarray, y: np.ndarray, grad: dict | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of the probability of each next word; with ``grad`` (zeros) also the gradient of the states (of -weight * sum)."""
        p, k, weight = self.p, self.hidden, weight if grad is not None else 0
        kind = self.kind[y]
        order = np.argsort(kind, kind="stable")
        kind, place = kind[order], (y - self.edges[kind])[order]
        s = np.ones((len(y), k + 1), states.dtype)  # the last column takes the biases
        s[:, :k] = states.take(order, 0)
        wc, wo = np.vstack([p["wc"], p["bc"]]).T, np.column_stack([p["wo"], p["bo"]])
        most = max((np.abs(w) @ np.ones(k + 1, w.dtype)).max() for w in (wc, wo))
        small = bool(most * max(s.max(), -s.min()) < SMALL) if len(y) else True
        bounds = np.searchsorted(kind, np.arange(self.classes + 1))
        lp, share = self._chosen(wc @ s.T, kind, weight, small)
        if grad is not None:
            g = (share @ s).T
            grad["wc"][:], grad["bc"][:] = g[:k], g[k]
            d = share.T @ p["wc"].T
        for c, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a == b:
                continue
            own = slice(int(self.edges[c]), int(self.edges[c + 1]))
            more, share = self._chosen(wo[own] @ s[a:b].T, place[a:b], weight, small)
            lp[a:b] += more
            if grad is not None:
                g = share @ s[a:b]
                grad["wo"][own], grad["bo"][own] = g[:, :k], g[:, k]
                d[a:b] += share.T @ p["wo"][own]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return lp.take(back), d.take(back, 0) if grad is not None else None

    @staticmethod
    def _chosen(x: np.ndarray, which: np.ndarray, weight: float, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log of the softmax of each column at ``which``; with a weight also the gradient of -weight * its sum. ``x`` is used up; ``small``: its exponential is in range."""
        if not small:
            x -= x.max(0)
        column = np.arange(x.shape[1])
        chosen = x[which, column]
        share = np.exp(x, out=x)
        total = share.sum(0)
        if weight:
            share *= weight / total
            share[which, column] -= weight
        return chosen - np.log(total), share

    def gradient(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log probability of a window, its gradient (cut at the window's start) and the last state."""
        p, k, trace, flat = self.p, self.hidden, [], np.zeros_like(self.flat)
        grad = self.parts(flat)
        states = self.states(x, keep, h, trace)
        own = valid.ravel()
        at = np.flatnonzero(own)
        lp, d = self.log_probs(states.reshape(-1, k).take(at, 0), y.ravel().take(at), grad, 1.0 / max(1, len(at)))
        if len(at) < own.size:
            d, ds = np.zeros((own.size, k), states.dtype), d
            d[at] = ds
        d = d.reshape(*x.shape, k)
        gx, gh = np.empty((3 * k, *x.shape), states.dtype), np.empty((3 * k, x.shape[1]), states.dtype)
        back, gu = np.zeros((k, x.shape[1]), states.dtype), np.zeros((3 * k, k), states.dtype)
        for t in reversed(range(len(x))):  # on arrays that stay in the cache, (unit, lane) like those of the trace
            before, z, r, c, inner = trace[t]
            g = np.add(back, d[t].T, order="C")
            back = g * z
            g -= back
            to = before - c
            to *= back
            np.multiply(to, 1 - z, out=gh[:k])
            c *= c
            c *= g
            g -= c
            np.multiply(g, r, out=gh[2 * k :])
            np.multiply(gh[2 * k :], inner, out=gh[k : 2 * k])
            gh[k : 2 * k] *= 1 - r
            back += p["u"] @ gh
            back *= keep[t]
            gu += gh @ before.T
            gx[: 2 * k, t], gx[2 * k :, t] = gh[: 2 * k], g
        grad["u"][:] = gu.T
        gx, word, n = gx.reshape(3 * k, -1), x.ravel().astype(np.intp), len(self.kind)
        rare = np.flatnonzero(word == RARE)
        word[rare] = n + rare % SPREAD  # sums of a word that comes often wait for each other
        sums = np.empty((3 * k, n + SPREAD), states.dtype)
        for total, each in zip(sums, gx, strict=True):
            total[:] = np.bincount(word, each, n + SPREAD)
        sums[:, RARE] = sums[:, n:].sum(1)
        grad["wx"][:] = sums[:, :n].T
        gx.sum(1, out=grad["b"])
        return float(-lp.sum() / max(1, own.sum())), flat, states[-1]


def lanes_of(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Documents dealt to at most ``most`` lanes, longest first to the lane that ends first; lanes by falling length."""
    heap = [(0, k) for k in range(max(1, min(most, len(lengths))))]
    lanes: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        lanes[k].append(d)
        total[k] = n + int(lengths[d])
        heapq.heappush(heap, (total[k], k))
    return [lanes[k] for k in sorted(range(len(lanes)), key=lambda k: (-total[k], k)) if lanes[k]]


class Lanes:
    """Documents dealt to lanes; as large as the words, whatever the longest lane. Windows are cut out when they are read."""

    def __init__(self, before: np.ndarray, ids: np.ndarray, ptr: np.ndarray, most: int):
        lanes = lanes_of(np.diff(ptr), most)
        order = np.array([d for lane in lanes for d in lane], np.int64)
        n = np.diff(ptr)[order]
        at = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(ptr[order] - at[:-1], n) + np.arange(at[-1])
        self.x, self.y, self.doc = before[place], ids[place], np.repeat(order, n).astype(np.int32)
        self.first = np.zeros(len(place), bool)
        self.first[at[:-1][n > 0]] = True
        self.size = np.array([sum(int(ptr[d + 1] - ptr[d]) for d in lane) for lane in lanes], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def windows(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(time, lane) arrays: word before, next word, whether the document goes on, its number, whether there is one; lanes that ended are left out."""
        for a in range(0, int(self.size.max(initial=0)), length):
            n = int((self.size > a).sum())
            t = np.arange(a, min(a + length, int(self.size[0])))[:, None]
            valid = t < self.size[:n]
            at = np.where(valid, self.base[:n] + t, self.base[:n])
            yield self.x.take(at), self.y.take(at), (~self.first.take(at)).astype(np.float32), self.doc.take(at), valid


def words_before(ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The word before each word; END before a document's first."""
    out = np.concatenate([[END], ids[:-1]]).astype(np.int32)[: len(ids)]
    out[ptr[:-1][np.diff(ptr) > 0]] = END
    return out


def segments(ptr: np.ndarray, most: int) -> np.ndarray:
    """``ptr`` with documents cut after every ``most`` words."""
    n = np.diff(ptr)
    parts = -(-n // most)
    first = np.cumsum(parts) - parts
    return np.append(np.repeat(ptr[:-1], parts) + most * (np.arange(parts.sum()) - np.repeat(first, parts)), ptr[-1])


class Adam:
    def __init__(self, model: GRU):
        self.m, self.v, self.work, self.step = np.zeros_like(model.flat), np.zeros_like(model.flat), np.empty_like(model.flat), 0

    def update(self, model: GRU, g: np.ndarray, rate: float) -> None:
        self.step += 1
        g *= np.float32(0.1 * min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9)))
        self.m *= np.float32(0.9)
        self.m += g
        g *= g  # a hundredth of the gradient's square
        self.v *= np.float32(0.99)
        self.v += g
        np.sqrt(self.v, out=self.work)
        grown = np.sqrt(1 - 0.99**self.step)
        self.work += np.float32(1e-6 * grown)
        np.divide(self.m, self.work, out=self.work)
        self.work *= np.float32(rate * grown / (1 - 0.9**self.step))
        model.flat -= self.work


def learn(model: GRU, adam: Adam, ids: np.ndarray, ptr: np.ndarray, rate, lanes: int = LEARN_LANES, window: int = WINDOW) -> tuple[float, int]:
    """One pass of truncated backpropagation; the state goes on from window to window. ``rate`` gives a step's rate by its number. Returns the loss and the words."""
    h, losses, mass = None, 0.0, 0
    for x, y, keep, _, valid in Lanes(words_before(ids, ptr), ids, segments(ptr, SEGMENT), lanes).windows(window):
        n = x.shape[1]
        loss, grad, h = model.gradient(x, y, keep, valid, np.zeros((n, model.hidden), np.float32) if h is None else h[:n])
        losses, mass = losses + loss * valid.sum(), mass + int(valid.sum())
        adam.update(model, grad, rate(adam.step + 1))
    return float(losses), mass


def train(model: GRU, ids: np.ndarray, ptr: np.ndarray, epochs: int = 8, rate: float = 0.01, lanes: int = 48, window: int = WINDOW) -> list[float]:
    """``epochs`` passes with a falling rate. Returns each one's mean loss."""
    adam, out = Adam(model), []
    for e in range(epochs):
        loss, mass = learn(model, adam, ids, ptr, lambda _, e=e: rate * (1 - 0.9 * e / epochs), lanes, window)
        out.append(loss / max(1, mass))
    return out


def added(a: tuple | None, b: tuple | None) -> tuple | None:
    """Sum of two (words, documents, weights times words)."""
    if a is None or b is None:
        return a if b is None else b
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def train_round(model: GRU, lookup: Lookup, texts: DataFrame, rate: float, tasks: int) -> tuple[int, int]:
    """Replaces the weights of ``model`` by the mean of those that at most ``tasks`` tasks learn from ``texts``; returns (words, documents) learnt from."""
    shared = texts.sparkSession.sparkContext.broadcast((model, lookup))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, look = shared.value
        net = copy.deepcopy(net)
        adam, seen, docs = Adam(net), 0, 0
        held, size = [], 0

        def settle() -> None:
            nonlocal seen, docs, size
            low, starts, ends, ptr = words(*buffers(pa.concat_arrays(held)))
            seen += learn(net, adam, *with_ends(look(word_hashes(low, starts, ends))[2], ptr), lambda _: rate)[1]
            docs += len(ptr) - 1
            held.clear()
            size = 0

        for batch in batches:
            for part in slices(batch, 0, LEARN_BYTES):
                held.append(part.column(0))
                size += part.column(0).nbytes
                if size >= LEARN_BYTES:
                    settle()
        if held:
            settle()
        if seen:
            yield pa.RecordBatch.from_pydict({"words": [seen], "docs": [docs], "weights": [net.flat.tobytes()]})

    learnt = texts.coalesce(tasks).mapInArrow(run, "words long, docs long, weights binary").rdd
    found = learnt.map(lambda r: (r[0], r[1], np.frombuffer(bytes(r[2]), np.float32).astype(np.float64) * r[0])).treeAggregate(None, added, added, 3)
    shared.unpersist()
    if found is None:
        return 0, 0
    model.flat[:] = found[2] / found[0]
    return found[0], found[1]


def train_on_all(model: GRU, lookup: Lookup, training: DataFrame, n_words: int, epochs: int = 1, rate: float = 0.05) -> tuple[int, int]:
    """Every row of ``training`` (doc_id, text) is learnt from ``epochs`` times, in ROUNDS parts each. Returns the sums of train_round()."""
    tasks, out, rounds = max(1, n_words // TASK_WORDS), (0, 0), epochs * ROUNDS
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(ROUNDS))
    for r in range(rounds):
        got = train_round(model, lookup, training.filter(bucket == r % ROUNDS).select("text"), rate * (1 - 0.9 * r / rounds), tasks)
        out = out[0] + got[0], out[1] + got[1]
    return out


def score(model: GRU, ids: np.ndarray, ptr: np.ndarray, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Natural log probability of each document under the model's vocabulary."""
    out, h = np.zeros(len(ptr) - 1), None
    held, size = [], 0

    def settle() -> None:
        states, y, doc = (np.concatenate(a) if len(a) > 1 else a[0] for a in zip(*held, strict=True))
        out[:] += np.bincount(doc, model.log_probs(states, y)[0], len(out))
        held.clear()

    for x, y, keep, doc, valid in Lanes(words_before(ids, ptr), ids, ptr, lanes).windows(window):
        n = x.shape[1]
        states = model.states(x, keep, np.zeros((n, model.hidden), np.float32) if h is None else h[:n])
        h = states[-1]
        at = np.flatnonzero(valid)
        held.append((states.reshape(-1, model.hidden).take(at, 0), y.take(at), doc.take(at)))
        size += len(held[-1][1])
        if size >= 8192:  # where few lanes are left, windows are gathered
            settle()
            size = 0
    if held:
        settle()
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, t): counts of all words of ``docs`` (text, held) in rows that are not held and in all, and under END_HASH the numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 16 << 20):
                low, starts, ends, ptr = words(*buffers(part.column(0)))
                found = word_hashes(low, starts, ends)
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                of = np.repeat(held, np.diff(ptr))
                for flag in (False, True):
                    h, n = np.unique(found[of == flag], return_counts=True)
                    n = np.append(n, (held == flag).sum()).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"h": np.append(h.view(np.int64), END_HASH), "c": np.zeros_like(n) if flag else n, "t": n})

    return docs.select("text", "held").mapInArrow(run, "h long, c long, t long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The words of the highest classes of counts (sixteenths of a power of two) that hold at most ``most`` words together,
    and of the next class a share by hash that fills it up.

    No task sends more than what is kept: the classes' sizes come first, about a thousand rows at most.
    """
    kind, share = F.floor(F.log2("t") * 16), F.pmod(F.xxhash64("h"), F.lit(1 << 20))
    held = 0
    for r in sorted(counts.groupBy(kind.alias("k")).count().collect(), key=lambda r: -r["k"]):
        if held + r["count"] > most:
            return counts.filter((kind > r["k"]) | (kind == r["k"]) & (share < (most - held) * (1 << 20) // r["count"])).collect()
        held += r["count"]
    return counts.collect()


class Lookup:
    """Counts and model numbers of the frequent words by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, vocabulary: int):
        """``counts`` by falling size; words without one get no number."""
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        number = np.full(len(hashes), RARE, np.int32)
        own = min(vocabulary - 2, int((counts > 0).sum()))
        number[:own] = np.arange(2, 2 + own)
        self.number = number[order]
        # Where the hashes of each run of leading bits begin: a few steps on instead of a binary search.
        self.first = np.searchsorted(self.hashes, np.arange(1 << LEADING, dtype=U64) << U64(64 - LEADING))
        self.padded = np.append(self.hashes, U64((1 << 64) - 1))

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is frequent, count, model number) of each word."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.full(len(h), RARE, np.int32)
        at = self.first[(h >> U64(64 - LEADING)).astype(np.int64)]
        todo = np.flatnonzero(self.padded[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.padded[at[todo]] < h[todo]]
        at = np.minimum(at, len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return hit, np.where(hit, self.counts[at], 0), np.where(hit, self.number[at], RARE)


def with_ends(ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with END after each document's."""
    out_ptr = ptr + np.arange(len(ptr))
    out = np.full(out_ptr[-1], END, np.int32)
    keep = np.ones(len(out), bool)
    keep[out_ptr[1:] - 1] = False
    out[keep] = ids
    return out, out_ptr


def language_model_scores(docs: DataFrame, held_out_mod: int = 10, vocabulary: int = 4096, frequent: int = 131_072, epochs: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Learns from all rows with crc32(doc_id) mod ``held_out_mod`` other than 0, ``epochs`` times; the weights depend on how
    the rows lie in partitions. Scores are log10; score is the model's, base_score the smoothed unigram's. A null text is
    empty: its one token is the end. A text of any length is scored whole, in memory linear in its words. Repeated rows come
    back as often; without any training row all counts are 0. A null doc_id is never held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    held = held_out(F.col("doc_id"), held_out_mod)
    counts = stored(word_counts(docs.select("text", held.alias("held"))), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_all, v_all = int(total[0]), int(total[1])
    found = counts.filter(F.col("h") == END_HASH).collect()
    end_count = found[0]["c"] if found else 0
    top = sorted(_most_frequent(counts.filter(F.col("h") != END_HASH), frequent), key=lambda r: (-r["c"], r["h"]))
    hashes, c = np.array([r["h"] for r in top], np.int64).view(U64), np.array([r["c"] for r in top], np.int64)
    lookup = Lookup(hashes, c, vocabulary)
    known = c[c > 0][: vocabulary - 2]
    rare_mass = (n_all - end_count - int(known.sum())) + SMOOTH * (v_all - len(known))  # smoothed mass of all rarer words, unseen ones as one
    model = GRU(np.concatenate([[end_count, rare_mass], known]).astype(float))
    train_on_all(model, lookup, docs.filter(~held), n_all, epochs)
    shared = spark.sparkContext.broadcast((model, lookup))  # sizes fixed by ``vocabulary`` and ``frequent``
    scale = np.log10(n_all + SMOOTH * (v_all + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, look = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 1, 16 << 20):
                n = part.num_rows
                low, starts, ends, ptr = words(*buffers(part.column(1)))
                h = word_hashes(low, starts, ends)
                hit, count, number = look(h)
                doc = np.repeat(np.arange(n), np.diff(ptr))
                base = np.bincount(doc[hit], np.log10(count[hit] + SMOOTH), n) + np.log10(end_count + SMOOTH)
                model_rare = number == RARE
                share = np.bincount(doc[hit & model_rare], np.log10(count[hit & model_rare] + SMOOTH), n)
                lp = score(net, *with_ends(number, ptr)) / np.log(10)
                lp += share - np.bincount(doc[model_rare], minlength=n) * np.log10(max(rare_mass, SMOOTH))
                far, cuts = h[~hit].view(np.int64), np.concatenate([[0], np.cumsum(~hit)])[ptr]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n)), part.column(0), pa.array(np.diff(ptr) + 1), pa.array(np.bincount(doc[hit & (count > 0)], minlength=n) + int(end_count > 0)), pa.array(base), pa.array(lp), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(far))],
                    names=["row", "doc_id", "n_tokens", "known", "base", "lp", "far"],
                )
                row += n

    kind = dict(docs.dtypes)["doc_id"]
    scored = stored(docs.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, lp double, far array<long>"), "scored")
    far = scored.select("row", F.explode("far").alias("h"))  # words that are rare in all rows, so no hash is hot
    gathered = far.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("logs"), F.count_if(F.col("c") > 0).alias("more")
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("far").join(gathered, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), held_out_mod).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(float(scale))).alias("base_score"), (F.col("lp") + logs).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
