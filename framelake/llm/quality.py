"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-proximal).

Tokens are runs of letters and digits (any non-ASCII byte counts as a letter) or of other signs; case counts.
A document's features are its tokens, its pairs of adjacent tokens, and "same word as before", hashed to
2**bits places; the value of each is its count over the square root of all counts. Scoring gathers the weights
of a document's features: a sparse dot product.

Nulls and empty texts have only the bias as feature. Ties and repeated rows are scored alike. An empty table gives
an empty result; without labelled rows every score is 0.5. Other columns pass through; an earlier column named like
a new one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import small_batches, with_columns_from_arrow

BITS = 18
#: Labelled rows that training reads at most, about (a hash of the id decides); of each shard, a twentieth part at least.
TRAIN_ROWS = 20_000
SHARD_ROWS = 2_500

KIND = np.ones(256, np.uint8)
KIND[[c for c in range(128) if not chr(c).isalnum()]] = 2
KIND[spans.SPACE] = 0
SAME = np.uint64(0x51AE51AE51AE51AE)


def features(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all features of a block of texts, text by text, and where each text's begin."""
    start, end = spans.runs(KIND[raw], at)
    one = spans.span_hash(spans.prefix(raw), start, end)
    text = np.searchsorted(at, start, "right") - 1
    inner = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    before, after = one[inner], one[inner + 1]
    two = spans.mix(before * np.uint64(31) + after)
    same = inner[before == after]
    places = np.concatenate([one, two, np.full(len(same), SAME, np.uint64)])
    owner = np.concatenate([text, text[inner], text[same]])
    order = np.argsort(owner, kind="stable")
    return (places[order] >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(owner[order], np.arange(len(at)))


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 10.0
    beta: float = 1.0
    l1: float = 5e-4
    l2: float = 0.0
    epochs: int = 3

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        slack = np.abs(z) - self.l1
        return np.where(slack <= 0, 0.0, -np.sign(z) * slack / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
        """Weights of the places, and last the bias; one pass over the rows in a fixed random order per epoch."""
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        sparse = []
        for f in rows:
            place, count = np.unique(f, return_counts=True)
            sparse.append((np.append(place, 1 << bits), np.append(count / max(1, len(f)) ** 0.5, 1.0)))
        for epoch in range(self.epochs):
            for i in np.random.default_rng(seed + epoch).permutation(len(rows)):
                at, value = sparse[i]
                w = self.weights(z[at], n[at])
                gradient = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - labels[i]) * value
                grown = n[at] + gradient**2
                z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / self.alpha * w
                n[at] = grown
        return self.weights(z, n)


def fit(labelled: DataFrame, label: str = "label", text: str = "text", key: str = "doc_id", rows: int = 0, bits: int = BITS, ftrl: Ftrl = Ftrl()) -> np.ndarray:
    """Train on labelled rows: shards of about SHARD_ROWS rows learn apart, their weights are averaged (parameter mixing).

    rows: about how many rows there are, to choose the number of shards; each shard gives one row of 2**bits doubles.
    """
    small_batches(labelled.sparkSession)
    shards = max(1, min(8, round(rows / SHARD_ROWS)))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        found: list[np.ndarray] = []
        raw, at = spans.utf8(table["text"])
        for _, _, block, offsets in spans.blocks(raw, at):
            places, begin = features(block, offsets, bits)
            found += [places[begin[k] : begin[k + 1]] for k in range(len(offsets) - 1)]
        w = ftrl.fit(found, table["label"].to_numpy().astype(float), bits)
        return pa.table({"n": pa.array([len(found)], pa.int64()), "w": pa.array([w.astype("<f8").tobytes()], pa.binary())})

    ready = labelled.where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
    parts = ready.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(learn, "n long, w binary").collect()
    total = sum(r.n for r in parts)
    return sum((np.frombuffer(r.w, "<f8") * (r.n / total) for r in parts), np.zeros((1 << bits) + 1))


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0), in one pass without a shuffle."""
    bits = len(weights).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        w = shared.value
        logit = np.full(batch.num_rows, w[-1])
        raw, at = spans.utf8(batch.column(text))
        for i, j, block, offsets in spans.blocks(raw, at):
            places, begin = features(block, offsets, bits)
            sums = np.concatenate([[0.0], np.cumsum(w[places])])
            logit[i:j] += (sums[begin[1:]] - sums[begin[:-1]]) / np.sqrt(np.maximum(1, np.diff(begin)))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return with_columns_from_arrow(docs, "score double, predicted int", make)


def sampled(labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id") -> tuple[DataFrame, int]:
    """About `rows` of the distinct labels at most, chosen by a hash of the id, and about how many."""
    labels = labels.distinct()
    n = labels.count()
    share = 1 << 20 if n <= rows else (rows << 20) // n
    return labels.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)) < share), min(n, rows)


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from docs joined with labels(doc_id, label); a label stated twice counts once.

    The labels sent to all executors are about `rows` at most. So are the documents they meet: where ids repeat and more
    do, a hash of id and text decides which are read, and equal rows are read once.
    """
    some, n = sampled(labels.where(F.col("label").isNotNull()).select("doc_id", "label"), rows)
    met = docs.select("doc_id").join(F.broadcast(some), "doc_id").count()
    read = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    if met > n:
        read = read.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("row")), F.lit(1 << 20)) < max(1, (rows << 20) // max(rows, met))).distinct()
    return fit(read, rows=min(met, rows))
