"""Language identification: the nearest of several centroids per language, over TF-IDF vectors of byte trigrams.

Trigrams of the lower-cased (ASCII) bytes are hashed to 2**bits places; a vector is log(1 + count) * idf, normalised.
idf covers all learning documents. Each language's centroids come from spherical k-means over a bounded sample of its
documents. A text gets the language of the centroid with the greatest cosine; if even that is under `reject`, the
column `rejected` is true (the language stays as a guess).

A null text and one without any letter get `und` and score 0. Ties go to the first language in code point order,
repeated rows are judged alike, an empty table gives an empty result, and without learning rows all is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import small_batches, staged, with_columns_from_arrow

BITS = 12
#: Learning documents of a language that its centroids are fitted on, about (a hash of id and text decides).
FIT_ROWS = 2_000
CENTROIDS = 4
#: Centroids of all languages at most, 16 KB each: with more languages each has fewer, with more than this it is an error.
MOST_CENTROIDS = 16_384
REJECT = 0.15
_BLOCK = 1 << 18


def counts(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Trigram counts: a row for each text of the block."""
    n, places = len(at) - 1, 1 << bits
    if len(raw) < 3:
        return np.zeros((n, places), np.float32)
    value = spans.TABLE[spans.LOWER[raw]]
    base = np.uint64(spans.BASE)
    place = (spans.mix((value[:-2] * base + value[1:-1]) * base + value[2:]) >> np.uint64(64 - bits)).astype(np.int64)
    text = np.repeat(np.arange(n), np.diff(at))
    inside = text[:-2] == text[2:]
    return np.bincount(text[:-2][inside] * places + place[inside], minlength=n * places).reshape(n, places).astype(np.float32)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v


def centroids(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; an empty cluster keeps its centre."""
    c = v[np.linspace(0, len(v) - 1, min(k, len(v))).astype(int)].copy()
    for _ in range(rounds):
        near = (v @ c.T).argmax(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = v[near == i].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]


def fit(docs: DataFrame, bits: int = BITS, rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """Learn from docs(doc_id, text, lang), rows without text or lang apart.

    To the driver go one document-frequency row per place and k centroids per language, MOST_CENTROIDS in all at most;
    a table with more languages than that raises an error. Equal rows are fitted once.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("key"), "text", F.col("lang").cast("string").alias("lang"))

    def frequencies(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            raw, at = spans.utf8(batch.column("text"))
            for i, j, block, offsets in spans.blocks(raw, at, _BLOCK):
                total += (counts(block, offsets, bits) > 0).sum(0)
                n += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << bits)), pa.array(np.append(n, total))], names=["place", "n"])

    found = known.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << bits) + 1)
    for r in found:
        df[r.place] = r.n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    idf = idf.astype(np.float32)

    sizes = staged(known.groupBy("lang").count(), "langid-sizes")
    langs = sizes.count()
    if langs > MOST_CENTROIDS:
        raise ValueError(f"{langs} languages, at most {MOST_CENTROIDS} can be learnt")
    k = min(k, MOST_CENTROIDS // max(1, langs))
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count")).alias("share"))
    # one row per language, MOST_CENTROIDS at most
    some = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("key", "text", F.lit("fit")), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "key", "text").distinct()

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        raw, at = spans.utf8(table["text"])
        v = np.concatenate([vectors(counts(block, offsets, bits), idf) for _, _, block, offsets in spans.blocks(raw, at, _BLOCK)])
        c = centroids(v, k)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c)), "n": pa.array(range(len(c)), pa.int32()), "c": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary())})

    made = sorted(some.groupBy("lang").applyInArrow(cluster, "lang string, n int, c binary").collect(), key=lambda r: (r.lang, r.n))
    return Model(idf, np.array([np.frombuffer(r.c, "<f4") for r in made]).reshape(len(made), 1 << bits), [r.lang for r in made])


def predicted(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and rejected, in one pass without a shuffle."""
    bits = len(model.idf).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
        raw, at = spans.utf8(batch.column("text"))
        if m.langs:
            for i, j, block, offsets in spans.blocks(raw, at, _BLOCK):
                near = vectors(counts(block, offsets, bits), m.idf) @ m.centres.T
                best[i:j] = near.argmax(1)
                score[i:j] = np.clip(near.max(1), 0, 1)
        best[~np.asarray(batch.column("__letters").to_numpy(zero_copy_only=False), bool)] = -1
        score[best < 0] = 0
        names = np.array([*m.langs, "und"], object)
        return [pa.array(names[best], pa.string()), pa.array(score), pa.array((best < 0) | (score < reject))]

    lettered = docs.withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return with_columns_from_arrow(lettered, "lang_pred string, score double, rejected boolean", make).drop("__letters")
