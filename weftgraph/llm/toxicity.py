"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import fold
from .work import python_stage, only

#: Features live in 2 ** BITS buckets; the model that is broadcast has at most as many float32 weights.
BITS = 20
#: Learning sample: at most so many labelled documents of each class, in hash order, and of those the ones with at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES, EPOCHS = 4_000, 64_000, 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 3.0, 1.0
CACHE_WORDS = 300_000
TOXIC = 0.7
WORD = re.compile(r"[^\W_]+")


class Features:
    """Distinct feature buckets of a text: words, pairs of neighbours, pairs with one word between."""

    def __init__(self, bits: int = BITS):
        self.shift, self.cache = np.uint64(64 - bits), {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash

        found = WORD.findall((text or "").lower())
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for w in found:
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))

    def of(self, h: np.ndarray) -> np.ndarray:
        a, b, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
        near = (h[:-1] * a + h[1:]) * mix
        skip = (h[:-2] * b + h[2:] + np.uint64(1)) * mix
        return np.unique(np.concatenate([h * mix, near, skip]) >> self.shift).astype(np.int64)


class Ftrl:
    """Per-coordinate rates; a weight is zero until its summed gradient exceeds the L1 strength."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(features, len(self.z) - 1)  # the last coordinate is the bias
        w = self.weights(at)
        g = weight * (sigmoid(w.sum()) - label)
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[tuple[str | None, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights as (coordinates, float32 values)."""
    made, model = Features(), Ftrl()
    rows = [(made.of(made.words(t)), y) for t, y in texts]
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights().astype(np.float32)
    at = np.flatnonzero(w)
    return at, w[at]


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> list[tuple[str | None, int]]:
    """At most ``per_class`` labelled documents of each class, by hash of their ids; of these the texts of at most SAMPLE_BYTES bytes."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).unionByName(
        known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class))
    short = docs.filter(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES))
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return [(r["text"], int(r["toxic"])) for r in rows.orderBy("doc_id").collect()]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, score over the whole text.

    Null and empty texts get the score of the bias alone. Each row gives one row; an empty table an empty
    result. Other columns are not read.
    """
    python_stage(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = held.value
        dense = np.zeros((1 << BITS) + 1, dtype=np.float32)
        dense[at] = values
        made = Features()
        for batch in batches:
            raw = [dense[made.of(made.words(x.as_py()))].sum(dtype=np.float64) + dense[-1] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sigmoid(np.array(raw, dtype=np.float64)))], names=["doc_id", "score"])

    return only(docs, id, text).mapInArrow(run, "doc_id long, score double")


def toxicity_table(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn on labels outside fold ``held``, score all documents. Without labels of both classes nothing is toxic.

    Null and empty texts are learnt and scored by the bias alone. Labels and documents without an id teach
    nothing; of repeated labels the highest counts, of repeated documents the greatest text. Documents of more
    than ``SAMPLE_BYTES`` bytes are scored whole but teach nothing. An empty table gives an empty result, an
    empty table of labels a model of which nothing is toxic. Other columns are not read.
    """
    rows = sample(only(docs, "doc_id", "text"), only(labels, "doc_id", "toxic").filter(fold(F.col("doc_id"), folds) != held))
    model = fit(rows) if len({y for _, y in rows}) == 2 else (np.array([1 << BITS]), np.array([-3.0], dtype=np.float32))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
