"""Supervised subword embeddings as a quality classifier (operator 10).

A text is the average of learned vectors of its words, of the 3- to 5-byte
n-grams of each marked word (<word>), and of its word pairs, all hashed into one
table; a softmax over the average gives the class.  One more feature, hashed and
learned as they are, is whether the words of a pair are one word twice, which no
n-gram of seen words can tell of unseen ones.  Both layers are trained by
stochastic gradient descent in numpy, on the driver, on whole labelled texts: at
most TRAIN_ROWS of each class and TRAIN_BYTES of both.

The output is linear in the average, so a trained model is one number for each
bucket and an offset: a megabyte, whatever the corpus.  Scoring is a map without
shuffle: words are told apart once for each slice of a batch, and only distinct
words are taken apart into n-grams.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BITS = 18
DIM = 8
GRAMS = (3, 4, 5)
#: The bound of the training sample: labelled rows of each class, those with the smallest hashes of their ids.
TRAIN_ROWS = 2000
#: The bound of their texts together, so that the driver's memory is bounded whatever their length.
TRAIN_BYTES = 256 << 20
EPOCHS = 5
RATE = 0.3
ACCEPT = 0.3
SLICE_BYTES = 2 << 20
_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


class Words:
    """Words of texts: for each text its words' numbers, for each distinct word its buckets."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        self.index, self.bounds = coded.indices.to_numpy(), bounds - bounds[0]
        words = pc.binary_join_element_wise("<", coded.dictionary.cast(pa.string()), ">", "")
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1) if len(words) else np.zeros(0, np.uint64)
        self.lengths = np.diff(offsets)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.lengths)
        self.data, self.offsets = data, offsets - offsets[0]
        # the word's own hash, independent of where it stands
        power = _P ** (np.arange(len(data), dtype=np.uint64) - np.repeat(self.offsets[:-1], self.lengths).astype(np.uint64))
        self.hashes = np.add.reduceat(data * power, self.offsets[:-1]) if len(words) else np.zeros(0, np.uint64)

    def grams(self):
        """(distinct word's number, bucket) arrays of words and n-grams."""
        yield np.arange(len(self.lengths), dtype=np.int32), _bucket(self.hashes, 1)
        for n in GRAMS:
            m = len(self.data) - n + 1
            if m > 0:
                h = np.zeros(m, np.uint64)
                for k in range(n):
                    h = h * _P + self.data[k : k + m]
                inside = self.word[:m] == self.word[n - 1 :]
                yield self.word[:m][inside], _bucket(h[inside], n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text's number, bucket) of neighbouring words."""
        text = np.repeat(np.arange(len(self.bounds) - 1, dtype=np.int32), np.diff(self.bounds))
        same = text[:-1] == text[1:]
        h = self.hashes[self.index]
        pair = _bucket((h[:-1] * _P + h[1:])[same], 2)
        # the pair's pattern as well: is it one word twice?
        pattern = _bucket((h[:-1] == h[1:])[same].astype(np.uint64), 9)
        return np.concatenate([text[:-1][same]] * 2), np.concatenate([pair, pattern])

    def counts(self) -> np.ndarray:
        """Features of each distinct word."""
        return 1 + sum(np.maximum(self.lengths - n + 1, 0) for n in GRAMS)


@dataclass
class Model:
    weights: np.ndarray  # of class 1 over class 0, by bucket
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1 of each text; nulls count as empty texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out, at = [np.zeros(0)], 0
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            out.append(self._slice(texts[at:upto]))
            at = upto
        return np.concatenate(out)

    def _slice(self, texts: pa.Array) -> np.ndarray:
        w = Words(texts)
        own = np.zeros(len(w.lengths))
        for word, bucket in w.grams():
            own += np.bincount(word, self.weights[bucket], len(own))
        text, bucket = w.pairs()
        n = len(texts)
        total = np.bincount(text, self.weights[bucket], n) if len(text) else np.zeros(n)
        count = np.bincount(text, minlength=n) if len(text) else np.zeros(n)
        row = np.repeat(np.arange(n), np.diff(w.bounds))
        total = total + np.bincount(row, own[w.index], n)
        count = count + np.bincount(row, w.counts()[w.index], n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.offset, -30, 30)))


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares of all its features."""
    times = np.bincount(w.index, minlength=len(w.lengths))
    parts = [(b, times[word]) for word, b in w.grams()]
    parts.append((p := w.pairs()[1], np.ones(len(p), np.int64)))
    buckets, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([x for _, x in parts]))
    return buckets.astype(np.int32), (n / n.sum()).astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Trains on whole texts; with one class only, or none, the model is that class's rate (0.5)."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(5 * (2 * y[0] - 1)) if len(y) else 0.0)
    features = [_features(Words(pa.array([x], pa.large_string()))) for x in texts]
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for r in rng.permutation(len(texts)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            buckets, share = features[r]
            hidden = share @ table[buckets]
            logits = out @ hidden + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y[r]] -= 1
            # a long text's features each have a small share; the step is scaled so that its average moves as a short one's does
            table[buckets] -= np.outer(share * (lr / (share @ share)), error @ out)
            out -= lr * np.outer(error, hidden)
            bias -= lr * np.float32(0.1) * error
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on at most rows labelled rows of each class whose crc32(key as text) mod 5 is not 0, with at most size bytes.

    The ids are picked first, 2 * rows at most, by hash, and broadcast to a scan of
    docs for lengths, of which those within size // 2 for each class, in the same
    order, are read; of an id that docs repeat, the smallest text counts.  Labels
    other than 0 and 1, ids that have both, null ids and rows without a text are
    left out; other columns are not looked at.
    """
    ids = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & (F.crc32(F.col("key").cast("string")) % 5 != 0))
    ids = ids.groupBy("key").agg(F.max("label").alias("label"), F.min("label").alias("other")).where("label = other").drop("other")
    picked = [ids.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "key")
    lengths = sample.groupBy("key").agg(F.max(F.octet_length("text")).alias("n"), F.first("label").alias("label"))
    upto = F.sum("n").over(W.partitionBy("label").orderBy(F.xxhash64("key"), "key"))
    within = lengths.withColumn("upto", upto).where(F.col("upto") <= size // 2).select("key", "label")
    got = texts.join(F.broadcast(within), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = sorted((r["key"], r["text"], r["label"]) for r in got.toLocalIterator())
    return fit([r[1] for r in found], [r[2] for r in found])


def score(docs: DataFrame, model: Model, accept: float = ACCEPT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row, by its whole text alone.

    A null text is the empty one, and has a score like any other; repeated rows have
    equal scores; an empty table gives none; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("key"), pa.array(shared.value.scores(b.column("text")), pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, score double")
    held = (F.crc32(F.col("key").cast("string")) % 5 == 0).alias("held_out")
    return out.select(F.col("key").alias(key), held, "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, model: Model, accept: float = ACCEPT, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores accept or more, with the columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            good = shared.value.scores(b.column(text)) >= accept
            yield b.filter(pa.array(good))

    return docs.mapInArrow(common.frugal(run), docs.schema)


def is_held_out(key: int) -> bool:
    return zlib.crc32(str(key).encode()) % 5 == 0


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model trained on the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
