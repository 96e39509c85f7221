"""Quality classifier: supervised embeddings of hashed words, word pairs and character n-grams.

A document is the average of the learned vectors of its features: words, the 3 to 5 character n-grams of words
between marks, and pairs of neighbouring words, hashed into shared buckets; each of the three kinds is averaged
by itself and weighs a third. A softmax layer on top gives class probabilities. Training is plain numpy stochastic
gradient descent over at most max_rows labelled rows (those of the lowest id hash): their feature counts are made by
many tasks, and one task learns from them, so that the driver only sees the model. For two classes the softmax over a
mean of vectors is a logistic of a mean of one number per feature, so scoring adds up one number for each. Words are
cut and numbered by Arrow, and each distinct word of a batch is hashed once, by numpy, over its characters.

Words are what stands between white space. Whole texts are scored. Null or empty texts, and those without words, take
the score of the bias alone. Null labels are no labels; several labels of one id count as their rounded mean, and
several rows of one id are learned from once, by the lowest text. With no labelled rows or a single class the score is
the smoothed share of label 1. Repeated rows are scored row by row. Empty tables give no rows. Only id and text are
read; columns named score or predicted are replaced by score_quality, and stay with keep_quality.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lean, mix64, ship
from .units import slices

BITS = 18
BUCKETS = 1 << BITS
PAIR = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
SAME = 0


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word in turn, the distinct words, words of each text)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat = lists.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy()]
    numbered = flat.filter(pa.array(kept)).dictionary_encode()
    return numbered.indices.to_numpy().astype(np.int64), numbered.dictionary, np.diff(ends)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


class WordHashes:
    """Of distinct words: hash, bucket of the word, and buckets of its n-grams (in turn, counts of them by word)."""

    def __init__(self, words: pa.Array):
        marked = pc.binary_join_element_wise("<", words, ">", "")
        self.sizes = pc.utf8_length(marked).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(points)) - np.repeat(self.starts, self.sizes)
        left = np.repeat(self.sizes, self.sizes) - place  # characters from here to the word's end
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(self.sizes.max(initial=1)) - 1, BASE)]), dtype=np.uint64)
            sums = np.add.reduceat(points * powers[place], self.starts) if len(points) else points
            self.hashes = mix64(sums)
            self.own = _bucket(self.hashes + np.uint64(1))
            self.grams = []  # (buckets at every place, whether an n-gram starts there) for each length
            h = points.copy()
            for n in range(2, 6):
                k = max(0, len(h) - n + 1)
                h[:k] = h[:k] * BASE + points[n - 1 :][:k]
                if n > 2:
                    self.grams.append((_bucket(h + np.uint64(n) * PAIR), left >= n))
        self.counts = sum(np.maximum(self.sizes - n + 1, 0) for n in (3, 4, 5))

    def gram_sums(self, value: np.ndarray) -> np.ndarray:
        """Sum of the values of each word's n-grams."""
        if not len(self.sizes):
            return np.zeros(0)
        total = np.zeros(int(self.sizes.sum()))
        for buckets, there in self.grams:
            total += np.where(there, value[buckets], 0)
        return np.add.reduceat(total, self.starts)

    def gram_buckets(self) -> np.ndarray:
        return np.concatenate([b[there] for b, there in self.grams])


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring word pairs from the words' hashes; a word that repeats itself has one bucket, whatever the word."""
    with np.errstate(over="ignore"):
        mixed = (hashes[:-1] * PAIR) ^ (hashes[1:] + PAIR)
        return np.where(hashes[:-1] == hashes[1:], SAME, ((mixed * PAIR) >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class Model:
    value: np.ndarray  # one number per bucket: vector . (w1 - w0)
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, words, counts = cut_words(texts)
        out = np.full(len(counts), float(self.bias))
        some = np.flatnonzero(counts)
        if len(some):
            value, hashed = self.value.astype(np.float64), WordHashes(words)
            n = counts[some]
            starts = np.cumsum(n) - n
            total = lambda x: np.add.reduceat(x, starts)  # noqa: E731  # by document, whatever stands beside it
            own, grams = total(value[hashed.own][codes]) / n, total(hashed.gram_sums(value)[codes]) / total(hashed.counts[codes])
            pairs = np.append(value[pair_features(hashed.hashes[codes])], 0.0)
            pairs[starts + n - 1] = 0.0  # from the last word of a document to the next one's first
            kinds = np.where(n > 1, 3, 2)
            out[some] += (own + grams + total(pairs) / np.maximum(n - 1, 1)) / kinds
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights of sum 1) of a whole text; both empty without words."""
    codes, words, _ = cut_words(pa.array([text], pa.string()))
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    hashed = WordHashes(words.take(pa.array(codes)))
    kinds = [hashed.own, hashed.gram_buckets()]
    if len(codes) > 1:
        kinds.append(pair_features(hashed.hashes))
    buckets, where = np.unique(np.concatenate(kinds), return_inverse=True)
    weights = np.concatenate([np.full(len(k), 1 / (len(k) * len(kinds))) for k in kinds])
    return buckets, np.bincount(where, weights).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [document_features(t) for t in b.column("text").to_pylist()]
        ids, weights = [f.astype("<i4").tobytes() for f, _ in made], [w.astype("<f4").tobytes() for _, w in made]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["y", "ids", "weights"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 10, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """rows: (label 0 or 1, feature buckets, their weights of sum 1)."""
    labels = np.array([y for y, _, _ in rows])
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    b[1] = np.log(labels.mean() / (1 - labels.mean()))
    steps, k = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            lr = np.float32(rate * (1 - k / steps))
            k += 1
            if not len(ids):
                continue
            h = share @ vectors[ids]
            z = w @ h + b
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = w.T @ g
            w -= lr * np.outer(g, h)
            b -= lr * np.float32(0.1) * g
            # a feature's gradient is its share; scaling by the number of features keeps rare ones moving
            vectors[ids] -= (lr * np.minimum(share * np.float32(len(ids)), 4) * np.float32(0.05))[:, None] * back
    return Model(vectors @ (w[1] - w[0]), float(b[1] - b[0]))


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += [(int(y > 0), np.frombuffer(i, "<i4"), np.frombuffer(w, "<f4")) for y, i, w in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    model = train(sorted(rows, key=lambda r: (r[0], len(r[1]), zlib.crc32(r[1]), zlib.crc32(r[2]))))  # an order of its own, whatever the partitions
    yield pa.RecordBatch.from_arrays([pa.array([model.value.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["value", "bias"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 2500) -> Model:
    """Learns label_col from at most max_rows labelled rows outside the held-out fifth (crc32(id) mod 5 = 0)."""
    ship(docs.sparkSession)
    key = F.col(id_col).cast("string")
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(key) % 5 != 0))
    told = told.groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    picked = told.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "_id")  # max_rows rows
    once = sample.groupBy("_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    features = once.select("y", "text").mapInArrow(lean(_counted), "y int, ids binary, weights binary")
    got = features.repartition(1).mapInArrow(lean(_learned), "value binary, bias double").first()  # one row for each of max_rows labels
    return Model(np.frombuffer(bytes(got["value"]), "<f4"), float(got["bias"])) if got else train([])


def _scored(shared, at: int, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                yield emit(b, shared.value.score(b.column(at)))

    return lean(run)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """All columns of docs (the text only if keep_text), plus score (0 to 1) and predicted (1 at or above threshold); these replace columns of their names."""
    ship(docs.sparkSession)
    docs = docs.drop(*{"score", "predicted"} - {text_col}).withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    names = [*(docs.columns[i] for i in kept), "score", "predicted"]

    def emit(b: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=names)

    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), at, emit), schema)  # BUCKETS numbers


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches threshold, with all columns as they are."""
    ship(docs.sparkSession)
    emit = lambda b, score: b.filter(pa.array(score >= threshold))
    return docs.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), emit), docs.schema)
