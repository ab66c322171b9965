"""What the operators of this subpackage share: the scratch tables, folds and text columns."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words, for java.util.regex, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that meets more than 1/HEAVY of all rows is dealt to several tasks.
HEAVY = 1024


def join_heavy(rows: DataFrame, keys: DataFrame, on: list[str], count: str, deal: list[str]) -> DataFrame:
    """rows joined with keys (one row for each value of `on`; `count`: the rows it meets) where one key may meet most rows.

    The rows of a heavy key are dealt by the columns `deal` to as many parts as it holds shares of total / HEAVY, and
    its row in keys goes to each part. There are at most 2 * HEAVY such keys, which are broadcast, with at most twice as
    many parts. keys is read twice, so it should be a staged table.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    share = max(1, total // HEAVY)
    heavy = F.broadcast(keys.where(F.col(count) > share).select(*on, F.ceil(F.col(count) / share).cast("int").alias("__parts")))
    part = F.pmod(F.xxhash64(*deal), F.coalesce("__parts", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    spread = keys.join(heavy, on, "left").withColumn("__part", copies).drop("__parts")
    return rows.join(heavy, on, "left").withColumn("__part", part).drop("__parts").join(spread, [*on, "__part"]).drop("__part")


def heavy_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(value, __parts) of the values that one of these columns holds in more than 1/HEAVY of rows, a staged table.

    At most HEAVY values a column, so the result is broadcast.
    """
    share = max(1, rows.count() // HEAVY)
    counts = [rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") > share) for c in columns]
    most = reduce(DataFrame.unionByName, counts).groupBy("value").agg(F.max("n").alias("n"))
    return F.broadcast(staged(most.select("value", F.ceil(F.col("n") / share).cast("int").alias("__parts")), "heavy"))


def join_dealt(rows: DataFrame, keys: DataFrame, on: str, heavy: DataFrame, deal: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keys on one column whose heavy_values() may meet most rows: those are dealt as in join_heavy."""
    parts = heavy.withColumnRenamed("value", on)
    part = F.pmod(F.xxhash64(*deal), F.coalesce("__parts", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    spread = keys.join(parts, on, "left").withColumn("__part", copies).drop("__parts")
    return rows.join(parts, on, "left").withColumn("__part", part).drop("__parts").join(spread, [on, "__part"], how).drop("__part")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(mod)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches that keep long texts within a worker's memory; Spark reads both settings when a query is planned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def with_columns_from_arrow(df: DataFrame, fields: str, make) -> DataFrame:
    """df and new columns from make(record batch) -> arrays; a column of df with a new column's name is replaced.

    fields: DDL of the new columns. No shuffle; batches are bounded by small_batches().
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    added = df.sparkSession.createDataFrame([], fields).schema
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in added}]
    every = df.columns

    def run(batches):
        for batch in batches:
            columns = dict(zip(every, batch.columns))
            yield pa.RecordBatch.from_arrays([*(columns[c] for c in kept), *make(batch)], names=[*kept, *added.names])

    schema = df.select(*kept).schema
    for f in added:
        schema = schema.add(f)
    return df.mapInArrow(run, schema)
