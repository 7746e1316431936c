"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; one logistic classifier per bit, on frequencies of hashed n-grams of letters, predicts
that bit. Decoding weighs every bit's logistic loss by how well the bit separates the training languages and takes the
codeword with the smallest sum; the score is the share of that codeword among all (softmax of the negative losses), and
a small lead over the second is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidemark.llm.memory import lean
from tidemark.llm.store import stored
from tidemark.llm.textops import LOWER, buffers

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes that are no part of an n-gram: ASCII other than letters counts as one blank.
LETTERS = LOWER.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(raw: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """A row per text: square roots of the shares of its hashed 1-, 2- and 3-grams of bytes, each order of norm 1."""
    n, size = len(offsets) - 1, 1 << bits
    out = np.zeros((n, size), np.float32)
    if not len(raw):
        return out
    low = LETTERS[raw].astype(np.uint32)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)  # one blank between words
    keep[offsets[:-1][offsets[:-1] < len(low)]] = True
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    low = low[keep]
    grams = np.empty((3, len(low)), np.uint32)
    grams[0] = low
    last = (ends[1:] - 1)[np.diff(ends) > 0]  # a text's n-grams end with blanks, whatever text follows in the batch
    after = np.append(low[1:], 32).astype(np.uint32)
    after[last] = 32
    second = np.append(after[1:], 32).astype(np.uint32)
    second[last] = 32
    grams[1] = after | (low << np.uint32(8))
    grams[2] = second | (grams[1] << np.uint32(8))
    third = size // 4  # one quarter for 1- and 2-grams each, a half for 3-grams
    for order, (base, width) in enumerate(((0, third), (third, third), (2 * third, 2 * third))):
        slot = ((grams[order] * np.uint32(2654435769)) >> np.uint32(32 - int(np.log2(width)))).astype(np.int64)
        for d in range(n):
            counts = np.bincount(slot[ends[d] : ends[d + 1]], minlength=width)[:width] if ends[d + 1] > ends[d] else None
            if counts is not None:
                out[d, base : base + width] = np.sqrt(counts / counts.sum())
    return out


def codewords(n: int, most: int = 31, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: the exhaustive code for up to five languages, else random columns chosen for distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [[1] + [1 if (c >> k) & 1 else -1 for k in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.int8).T
    rng, best, score = np.random.default_rng(seed), None, -1
    length = max(most, int(np.ceil(6 * np.log2(n))))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        far = ((length - code.astype(int) @ code.T.astype(int)) // 2 + length * np.eye(n, dtype=int)).min()
        if far > score:
            best, score = code, far
    return best


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, bit_weight: np.ndarray, bits: int, scale: float):
        self.langs, self.code, self.weights, self.bias, self.bit_weight, self.bits, self.scale = langs, code, weights, bias, bit_weight, bits, scale

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share and the lead over the second."""
        z = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -self.code[k] * z) * self.bit_weight).sum(1) for k in range(len(self.langs))], 1)
        share = np.exp(self.scale * (loss.min(1, keepdims=True) - loss))
        share /= share.sum(1, keepdims=True)
        top = np.sort(share, 1)[:, ::-1]
        return loss.argmin(1), top[:, 0], top[:, 0] - (top[:, 1] if share.shape[1] > 1 else 0)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], bits: int, rounds: int = 300, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """One logistic regression per bit by accelerated gradient descent, classes weighted to equal mass."""
    code = codewords(len(langs))
    target = code[y].astype(np.float32)
    mass = (1.0 / np.bincount(y, minlength=len(langs)).clip(1))[y].astype(np.float32)
    mass /= mass.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds if len(langs) > 1 else 0):
        g = -target / (1 + np.exp(target * (x @ w + b))) * mass[:, None]
        vw = 0.9 * vw - rate * 0.1 * (x.T @ g + decay * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum(0)
        w += vw
        b += vb
    margin = target * (x @ w + b)
    right = np.clip((mass[:, None] * (margin > 0)).sum(0), 1e-3, 1)  # weighted training accuracy of each bit
    weight = np.maximum(right - 0.5, 1e-3)
    return Model(langs, code, w, b, weight / weight.sum() * code.shape[1], bits, 1.0)


def _sample(docs: DataFrame, per_lang: int, sample_rows: int) -> tuple[DataFrame, int]:
    """About ``per_lang`` rows of every language by a hash of the row, fewer (32 at least) where that would pass ``sample_rows``; and twice the rows to expect."""
    counts = stored(docs.groupBy("lang").count(), "langs")
    n = counts.count()
    each = max(32, min(per_lang, sample_rows // max(1, n)))
    rate = counts.select("lang", (F.lit(float(each)) / F.col("count")).alias("__rate"))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return docs.join(F.broadcast(rate) if n < 100_000 else rate, "lang").filter(drawn < F.col("__rate")), 2 * each * n


def train(docs: DataFrame, per_lang: int = 600, sample_rows: int = 12_000, bits: int = 12, held_out_mod: int = 5) -> Model | None:
    """Learns from text and lang of documents outside the held-out fold; None without any.

    Every language is learnt. The classifiers see about ``per_lang`` documents of each (whole texts), and from
    ``sample_rows`` / ``per_lang`` languages on about ``sample_rows`` in all, but 32 of each: that many rows of 2^bits
    half-precision numbers reach the driver (100 MB at 12,000 rows), whatever the corpus. The sample is by a hash of the
    rows; a row that repeats without end is cut off at twice the rows to expect.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), held_out_mod))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = features(*buffers(part.column(1)), bits).astype(np.float16)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0).cast(pa.string()), "lang": part.column(2), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    sample, most = _sample(known, per_lang, sample_rows)
    rows = sample.select("doc_id", "text", "lang").mapInArrow(lean(run), "doc_id string, lang string, x binary")
    rows = rows.limit(max(1, most)).collect()  # the limit holds if one row repeats without end
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] or ""))
    langs = sorted({r["lang"] for r in rows})
    y = np.array([langs.index(r["lang"]) for r in rows])
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return fit(x, y, langs, bits)


def held_out(doc_id, mod: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", unsure: float = 0.2) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous.

    A null text, or one without a letter, is ``und`` with score 0 and not ambiguous; so is every text if nothing was
    learned. Columns of these names in the input are replaced. Very long texts are read whole.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])
    shared = spark.sparkContext.broadcast(model)  # bits * codeword length numbers
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                letters = np.array([t is not None and LETTER.search(t) is not None for t in part.column(at).to_pylist()], bool)
                names, score, lead = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.ones(part.num_rows)
                if m is not None:
                    best, share, gap = m.decode(features(*buffers(part.column(at)), m.bits))
                    names[letters] = np.array(m.langs, object)[best[letters]]
                    score[letters], lead[letters] = share[letters], gap[letters]
                extra = [pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(lead < unsure)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "ambiguous")
