"""Product codes of vectors by whole-number k-means: exact products of limbs, so every machine gives the same codes.

A component x becomes floor(scale * x). Inner products go through float64 BLAS without rounding: integers are split into
limbs so narrow that a product over one part stays below 2**53; the products of limbs are put together in int64. The
nearest entry is the first smallest of |b|**2 - 2 a.b. A round is one pass over the staged integers: a task adds up its
parts of each entry, Spark adds the tasks' sums, and the driver holds the codebook alone (parts x entries x components).

Vectors that are null or hold null or non-finite components are dropped. Ids may repeat: a codebook starts from the
least ids, each once, with its smallest vector; a null id is greater than all. Fewer ids than entries make a shorter
codebook; no kept vector gives no rows. Kept vectors of different lengths, a length that `parts` doesn't divide, or
components so large that squared distances could leave 64 bits, raise ValueError. Other columns of the table take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, staged

#: Vectors that are compared with the codebook at once: a block of distances is ROWS x entries.
ROWS = 4096


def limb_bits(length: int) -> int:
    """Bits of a limb: length products of two limbs add up to less than 2**53."""
    return (53 - max(1, length).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays l with x = sum of l[i] * 2**(i * bits) and |l[i]| < 2**bits; as few as the largest of x needs."""
    sign, left, found = np.sign(x), np.abs(x), []
    while True:
        found.append((sign * (left & ((1 << bits) - 1))).astype(np.float64))
        left = left >> bits
        if not left.any():
            return found


def dots(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """a @ b.T of int64 matrices, exactly, by float64 products of limbs; the result has to fit 64 bits."""
    bits = bits or limb_bits(a.shape[1])
    total = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            total += (x @ y.T).astype(np.int64) << ((i + j) * bits)
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equal ones, and the squared distance."""
    far = (book * book).sum(1) - 2 * dots(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(1)


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _blocks(batches, n_parts: int):
    """(batch, vectors as rows x parts x components) of at most ROWS rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            block = batch.slice(k, ROWS)
            x = _matrix(block.column("v"))
            yield block, x.reshape(len(x), n_parts, -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """For each used (part, entry): how many parts it is nearest to, and their sum."""
    n_parts, entries, length = books.shape

    def add(batches):
        count, total = np.zeros((n_parts, entries), np.int64), np.zeros((n_parts, entries, length), np.int64)
        for _, x in _blocks(batches, n_parts):
            for p in range(n_parts):
                at, _ = nearest(x[:, p], books[p])
                count[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, x[:, p])
        p, e = np.nonzero(count)
        rows = total[p, e]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(rows), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    own = vectors.select("v").mapInArrow(add, "p long, e long, n long, s array<long>")
    sums = own.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(length)]).alias("s"))
    return {(r.p, r.e): (r.n, np.array(r.s, np.int64)) for r in sums.collect()}  # parts x entries rows


def _first_books(vectors: DataFrame, n_parts: int, entries: int) -> np.ndarray:
    ids = vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    # at most `entries` rows on either side
    first = vectors.join(F.broadcast(ids.withColumnRenamed("vec_id", "__id")), F.col("vec_id").eqNullSafe(F.col("__id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = first.orderBy(F.col("vec_id").asc_nulls_last()).collect()
    x = np.array([r.v for r in rows], np.int64)
    return np.ascontiguousarray(x.reshape(len(rows), n_parts, -1).swapaxes(0, 1))


def kept_vectors(table: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, label, v) of the vectors without null or non-finite components, as whole numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = table.where(x.isNotNull() & finite)
    big = F.exists(x, lambda e: F.abs(e.cast("double")) * scale >= float(1 << 31))
    v = F.when(big, F.raise_error("a component is too large for sums of squares in 64 bits")).otherwise(whole(x, scale))
    label = F.col("label") if "label" in [c.lower() for c in table.columns] else F.lit(None).cast("int")
    return kept.select(F.col(key).alias("vec_id"), label.alias("label"), v.alias("v"))


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components in order of part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def trained(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """The codebooks (parts, entries, components) after all rounds; vectors(vec_id, v) is read once a round."""
    shape = vectors.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("peak"), F.count("*").alias("n")).first()
    if not shape.n:
        return np.zeros((parts, 0, 0), np.int64)
    if shape.least != shape.most or shape.most % parts:
        raise ValueError(f"vectors have {shape.least} to {shape.most} components; all need the same number, a multiple of {parts}")
    if shape.most * (2 * (shape.peak or 0)) ** 2 >= 1 << 63 or shape.n * max(1, shape.peak or 0) >= 1 << 63:
        raise ValueError(f"components up to {shape.peak} are too large for sums of squares in 64 bits")
    books = _first_books(vectors, parts, entries)
    for _ in range(rounds):
        for (p, e), (n, total) in _sums(vectors, books).items():
            books[p, e] = total // n  # floors go down; unused entries stay
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): indexes in two hex digits each (four beyond 256 entries), and the squared distance summed over parts."""
    digits = "%02x" if books.shape[1] <= 256 else "%04x"
    names = np.array([digits % i for i in range(books.shape[1])], dtype=object)

    def run(batches):
        for block, x in _blocks(batches, len(books)):
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), np.int64)
            for p in range(len(books)):
                at, far = nearest(x[:, p], books[p])
                code, error = code + names[at], error + far
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = vectors.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    return vectors.mapInArrow(run, schema)


def compressed(table: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every kept vector, and the codebooks.

    label_error is the error summed over equal labels, nulls together; a label may hold most rows.
    """
    vectors = staged(kept_vectors(table, scale), "vectors")
    books = trained(vectors, parts, entries, rounds)
    if not books.size:
        codes = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        codes = encoded(vectors, books)
    marked = staged(codes.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = staged(marked.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")), "label-errors")
    out = join_heavy(marked, sums, ["__label"], "__n", ["vec_id", "code"]).drop("__label", "__n")
    return out.withColumn("codebooks_sha256", F.lit(books_sha256(books))), books


#: Four rounds of four parts; list_inner_product of whole numbers is exact below 2**53.
def _oracle(rounds: int = 4) -> str:
    def step(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (SELECT v.vec_id, v.p, arg_min(b.e, (b.bb - 2 * list_inner_product(v.x, b.x), b.e)) AS e FROM v JOIN b{i} b ON v.p = b.p GROUP BY v.vec_id, v.p),
m{i} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS DOUBLE) AS m
  FROM (SELECT a.p, a.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS i FROM a{i} a JOIN v ON a.vec_id = v.vec_id AND a.p = v.p) GROUP BY p, e, i) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS bb FROM (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)),"""

    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM k, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS bb FROM (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM v) WHERE e < 256),{"".join(step(i) for i in range(rounds))}
z AS (SELECT v.vec_id, v.p, arg_min(b.e, (b.bb - 2 * list_inner_product(v.x, b.x), b.e)) AS e, min(b.bb - 2 * list_inner_product(v.x, b.x)) + any_value(list_inner_product(v.x, v.x)) AS far
  FROM v JOIN b{rounds} b ON v.p = b.p GROUP BY v.vec_id, v.p),
c AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM z GROUP BY vec_id),
s AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ',') AS t FROM b{rounds}))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k ON c.vec_id = k.vec_id, s
"""


ORACLE_SQL = _oracle()
