"""Token counts with a digest cache: texts whose digest and tokenizer version are stored aren't encoded again.

The content that is digested is the text itself, null as empty: no further normalisation keeps every tokenizer's count.
The digest is SHA-256; a tokenizer's version is the SHA-256 of its file. Misses are made distinct before they are
encoded, so a group of copies costs one encoding, and are appended to the cache, which is partitioned by version.

An empty text has 0 tokens; very long texts are encoded whole; repeated rows share one entry; an empty table gives an
empty result and appends nothing. Other columns pass through; an earlier column named like a new one is replaced.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import join_heavy, small_batches, staged, text_of

CACHE = "version string, digest binary, n_tokens long"


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    """texts -> counts, with the library that the file's ending names; kept by the worker process."""
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def stored(spark: SparkSession, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def counted(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens; what the cache (a Parquet folder) lacks is encoded and appended to it.

    tokenizer: path of a .model or .json file that every executor has.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    version = version_of(tokenizer)
    digested = docs.withColumn("__digest", F.unhex(F.sha2(text_of(text), 256)))
    known = stored(spark, cache).where(F.col("version") == version).select(F.col("digest").alias("__digest"), "n_tokens")
    # copies are made one before the join, so a text that many documents have meets the cache once
    misses = digested.select("__digest", text_of(text).alias("text")).dropDuplicates(["__digest"]).join(known, "__digest", "left_anti")

    def encode(batches):
        count = _counter(tokenizer)
        for batch in batches:
            n = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([version] * batch.num_rows, pa.string()), batch.column("__digest"), n], names=["version", "digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").partitionBy("version").parquet(cache)
    # two writers may have stored the same digest
    counts = stored(spark, cache).where(F.col("version") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens"))
    copies = digested.groupBy("__digest").agg(F.count("*").alias("__copies"))
    counts = staged(counts.join(copies, "__digest"), "token-counts")
    sized = digested.withColumn("n_bytes", F.octet_length(text_of(text)).cast("long")).drop("n_tokens", text)
    sized = sized.withColumn("__row", F.monotonically_increasing_id())
    return join_heavy(sized, counts, ["__digest"], "__copies", ["__row"]).drop("__digest", "__copies", "__row")
