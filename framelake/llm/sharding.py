"""Contiguous shards of near-equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are put in order of the id by a range partitioning that is written once, so that a partition is a fixed bucket.
Bucket totals (one row a bucket) give each bucket's first byte, a window inside the bucket gives each row's; a row goes
to the shard in which its middle byte lies. No text is shuffled and no window spans more than a bucket.

Null texts have no bytes; null ids come first; ties and repeated rows are ordered by checksum and size, so equal
rows are interchangeable; one very long text may fill shards of its own share and leave some empty; an empty table
gives an empty result. Other columns of the table take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slot is the place inside the shard, in order of the id."""
    sized = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text_of(text)) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text_of(text)).alias("text_crc32"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "size"]
    ranged = staged(sized.repartitionByRange(parts, *order).withColumn("bucket", F.spark_partition_id()), "shards")

    total = ranged.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    first = total.select("bucket", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"))
    whole = total.agg(F.sum("bytes").alias("all_bytes"))

    inside = Window.partitionBy("bucket").orderBy(*order)
    placed = (
        ranged.join(F.broadcast(first), "bucket")  # as many rows as partitions
        .crossJoin(F.broadcast(whole))  # one row
        .withColumn("before", F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("at", F.col("row0") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least(((2 * before + size) * {shards}) div (2 * all_bytes), {shards - 1}) as int)"))
    )
    start = placed.groupBy("shard").agg(F.min("at").alias("start"))
    return placed.join(F.broadcast(start), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).alias("slot"))


#: The checksum is CRC-32 by its table, a byte at a time.
ORACLE_SQL = r"""
WITH n AS (SELECT unnest(range(256)) AS b),
k AS (SELECT list(list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS tab FROM n),
h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 16), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
  lambda a, b: xor(a // 256, tab[xor(a, b) % 256 + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM h, k),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, least(CAST((2 * before + size) * 40 // (2 * total) AS INTEGER), 39) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""
