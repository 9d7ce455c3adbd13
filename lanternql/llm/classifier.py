"""Quality classifier by supervised subword embeddings.

A document is the mean of learned vectors of its features: each word, each of its character n-grams (3 to
5, word ends marked) and each pair of neighbouring words, all hashed into ``BUCKETS`` rows.  A softmax
layer on the mean gives the classes.  Both are trained by plain stochastic gradient descent in numpy on
at most ``SAMPLE`` labelled documents of ``SAMPLE_BYTES`` together, those with the smallest hash of their id: a
bounded sample, so the training fits the driver whatever the corpus is.  Scoring covers all documents.

With two classes, a document's score is the logistic function of the mean of one number a feature, so
executors get one float a bucket (1 MB), and a word's sum over its own features is worked out once.

Defined results: null or empty texts have no features and get the score of the bias alone; a null doc_id
counts as empty text in the fold's checksum and is never learned from; labels that are null or not 0 or 1
are left out; repeated labels count each.  Extra columns are ignored; an empty table gives an empty table;
without labelled rows of both classes every score is the share of ones, or 0.5 without any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Numbers, per_worker, releasing, table, text_of, to_python

BUCKETS = 1 << 18
DIM = 12
NGRAMS = (3, 4, 5)
SAMPLE = 4000
#: Bytes of text in the sample; rows that would go beyond are passed over.
SAMPLE_BYTES = 64 << 20
EPOCHS = 6
RATE = 0.25
SEED = 7
FOLDS = 5
THRESHOLD = 0.3
#: Words whose sums a worker keeps, and their bytes: the memory bound of a cache, not of the result.
CACHE_WORDS = 1_000_000
CACHE_BYTES = 24 << 20
#: Bytes of a word up to which its n-grams are hashed one by one; beyond, and in scoring, in bulk.
LONG = 62
#: Bytes whose n-grams are hashed at a time.
BLOCK = 1 << 19


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its n-grams, on UTF-8 bytes, one by one; a word of more than ``LONG`` bytes gives
    its own here, and its n-grams come from ``grams``."""
    crc32 = zlib.crc32
    out = [crc32(word) % BUCKETS]
    marked = b"<" + word + b">"
    if len(word) <= LONG:
        for n in NGRAMS:
            out += [crc32(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the n-grams of all words, however long they are, in blocks of bounded size."""
    marked = b"<" + b"><".join(words) + b">"
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(marked, np.uint8)
    ends = np.cumsum(sizes)
    for a in range(0, data.size, BLOCK):
        place = np.arange(a, min(a + BLOCK, data.size))
        word = np.searchsorted(ends, place, "right")
        left = ends[word] - place
        for n in NGRAMS:
            here = left >= n
            at = place[here]
            c = np.full(at.size, n ^ 0xFFFFFFFF, np.uint32)
            for j in range(n):
                c = _CRC[(c ^ data[at + j]) & 0xFF] ^ (c >> 8)
            yield word[here], (~c % BUCKETS).astype(np.int32)


def pair_feature(a: int, b: int) -> int:
    """Bucket of two neighbouring words, from the buckets of both; a word said twice has one of its own."""
    return 0 if a == b else (a * 0x9E3779B1 + b * 0x85EBCA6B) % BUCKETS


def features(text: bytes | None, known: dict[bytes, list[int]]) -> np.ndarray:
    words = (text or b"").split()
    out: list[int] = []
    for w in words:
        if w not in known:
            known[w] = word_features(w)
            if len(w) > LONG:
                known[w] += [x for _, b in grams([w]) for x in b.tolist()]
        out += known[w]
    heads = [known[w][0] for w in words]
    out += [pair_feature(a, b) for a, b in zip(heads, heads[1:])]
    return np.array(out, np.int64)


def train(texts: list[bytes], labels: list[int], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Learn the model; returns it as one weight a bucket and a bias: the score of a document is
    ``sigmoid(mean of its features' weights + bias)``."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if y.size else 0.5
    if y.size == 0 or share in (0.0, 1.0):
        return np.zeros(BUCKETS, np.float32), float(np.log((share or 1e-6) / max(1e-6, 1 - share))) if y.size else 0.0
    known: dict[bytes, list[int]] = {}
    rows = []
    for t in texts:  # a document as its distinct features and their shares
        f, n = np.unique(features(t, known), return_counts=True)
        rows.append((f.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    known.clear()
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, w = rows[i]
            lr = rate * (1 - steps / total)
            steps += 1
            hidden = w @ vectors[f]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            down = out.T @ p
            out -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            # Shares make steps small for each feature; scaled by the length, as if features came one by one.
            vectors[f] -= (lr * 4) * np.outer(np.minimum(w * f.size, 20), down)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


class Scorer:
    """Scores whole texts.  Of each word met it keeps the bucket, the sum over its features, and their number."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.numbers = Numbers(CACHE_WORDS, CACHE_BYTES)
        self.forget()

    def forget(self) -> None:
        self.heads, self.sums, self.sizes = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        heads = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
        sums, sizes = self.weights[heads].astype(np.float64), np.ones(len(words), np.int64)
        for word, bucket in grams(words):
            sums += np.bincount(word, self.weights[bucket], len(words))
            sizes += np.bincount(word, minlength=len(words))
        self.heads, self.sums, self.sizes = (np.concatenate(x) for x in ((self.heads, heads), (self.sums, sums), (self.sizes, sizes)))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text_of(texts)))
        doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        flat = words.flatten()
        some = pc.greater(pc.binary_length(flat), 0)  # a text without words is split into one empty string
        doc, flat = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some)
        at, new, anew = self.numbers(flat)
        if anew:
            self.forget()
        if len(new):
            self.learn(new.cast(pa.binary()).to_pylist())
        n = len(texts)
        total, size = np.bincount(doc, self.sums[at], n), np.bincount(doc, self.sizes[at], n)
        heads = self.heads[at]
        next_to = doc[1:] == doc[:-1]
        a, b = heads[:-1][next_to], heads[1:][next_to]
        pairs = np.where(a == b, 0, (a * 0x9E3779B1 + b * 0x85EBCA6B) % BUCKETS)
        total += np.bincount(doc[1:][next_to], self.weights[pairs], n)
        size = size + np.bincount(doc[1:][next_to], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + self.bias, -60, 60)))


def score(texts: list[bytes | None], weights: np.ndarray, bias: float, known: dict) -> np.ndarray:
    """Scores of whole texts; ``known`` keeps the scorer of these weights from call to call."""
    if known.get("weights") is not weights:
        known.update(weights=weights, scorer=Scorer(weights, bias))
    return known["scorer"](pa.array(texts, pa.binary()))


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_quality"))
    rows = rows.where("_id is not null and _quality in (0, 1)").where(fold(F.col("_id")) != 0)
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_quality").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # The sample is the small side by its limit: SAMPLE rows of two numbers.
    got = chosen.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).withColumn("_h", F.xxhash64("text"))
    # Ids may repeat among the documents, so the bound holds again after the join, in rows and in bytes.
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")
    heads = got.select("doc_id", "_h", size, "_quality").orderBy(F.xxhash64("doc_id"), "doc_id", "_h", "_quality").limit(sample).collect()
    total, wanted = 0, []
    for r in heads:
        if total + r.n <= SAMPLE_BYTES:
            total += r.n
            wanted.append(r)
    keys = docs.sparkSession.createDataFrame(sorted({(r.doc_id, r._h) for r in wanted}), "k long, h long")
    found = got.join(F.broadcast(keys), (F.col("doc_id") == F.col("k")) & (F.col("_h") == F.col("h"))).select("doc_id", "_h", "text").dropDuplicates(["doc_id", "_h"])
    texts = {(r.doc_id, r._h): bytes(r.text or b"") for r in found.toLocalIterator()}
    got = sorted((r.doc_id, texts[r.doc_id, r._h], r._quality) for r in wanted)
    return train([t for _, t, _ in got], [q for _, _, q in got])


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    name = zlib.crc32(weights.tobytes()), bias

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        scorer = per_worker(("classifier", name), lambda: Scorer(sent.value, bias))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scorer(b.column(2)))], schema=schema)

    rows = to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    rows = rows.mapInArrow(releasing(run), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
