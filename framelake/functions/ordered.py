"""Numbers and running values inside groups of any size: range partitions, a total for each, offsets.

A window by group puts a whole group into one task. Here rows are dealt by ranges of (group, order), so a group that
holds most rows is many partitions. Each is scanned once and written; what a partition's last group has so far (one row
a partition) is added to the first group of the partitions after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import written


#: Bytes of rows that a function over whole groups holds at a time, about.
BATCH_BYTES = 16 << 20


def _starts(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """Whether each row begins a group; last: the keys of the row before, None at the start of a partition."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = last is None or any(c[0].as_py() != v for c, v in zip(columns, last))
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def _scan(x: np.ndarray, first: np.ndarray, held, kind: str) -> np.ndarray:
    """Running sums (or xors) that begin anew at each group's first row; held: the value that the first rows go on from."""
    total = np.cumsum(x) if kind == "sum" else np.bitwise_xor.accumulate(x)
    before = np.where(first > 0, total[first - 1], 0)  # rows before the first start of this batch have first = -1
    before[first < 0] = -held if kind == "sum" else held
    return total - before if kind == "sum" else total ^ before


def grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """df with each group's rows one after another in one task, by `order`, for functions over batches.

    Rows are dealt by a hash of the keys: where a join before has dealt by the keys themselves, Spark leaves out a shuffle by them,
    and may then read that join's partitions in pieces, as nothing tells it that a function over batches needs them whole.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = 1 << 15, size: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches of `grouped` rows anew, so that none splits a group, with the row at which each group starts.

    A new batch has about as many rows or bytes as given, or one group that is larger.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero(_starts([batch.column(k) for k in keys], None))

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(_starts([batch.column(k) for k in keys], last))
        last = [batch.column(k)[-1].as_py() for k in keys]
        if len(new) and sum(b.num_rows for b in held) + batch.num_rows >= rows or len(new) and sum(b.nbytes for b in held) + batch.nbytes >= size:
            # all but the group that the batch ends with
            at = int(new[-1])
            if at:
                held.append(batch.slice(0, at))
            if held:
                whole = joined()
                yield whole, starts(whole)
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        whole = joined()
        yield whole, starts(whole)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str | None = None, sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """df with `number` (0-based place inside the group, by `order`) and with `sums` and `xors` as running values, own row included.

    Nulls come first, and a null key is a group. sums and xors are long columns without nulls. Ties in order are settled
    by the shuffle, so order should tell rows apart. The result is a written table.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    values = {**{c: "sum" for c in sums}, **{c: "xor" for c in xors}, "__n": "sum"}
    schema = StructType(list(ranged.schema)).add("__n", "long").add("__at", "long")
    names = schema.names

    def scan(batches):
        last, held, at = None, dict.fromkeys(values, 0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(batch.schema.names, batch.columns))
            new = _starts([columns[k] for k in keys], last)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            columns["__at"] = pa.array(np.arange(at, at + len(new)))
            for c, kind in values.items():
                x = np.ones(len(new), np.int64) if c == "__n" else columns[c].to_numpy(zero_copy_only=False).astype(np.int64)
                out = _scan(x, first, held[c], kind)
                held[c], columns[c] = out[-1], pa.array(out)
            last, at = [columns[k][-1].as_py() for k in keys], at + len(new)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    parts = written(ranged.mapInArrow(scan, schema), "ordered")
    group = F.struct(*keys)
    ends = parts.groupBy("__part").agg(F.min_by(group, "__at").alias("__first"), F.max_by(F.struct(group.alias("key"), *values), "__at").alias("__end"))
    # one row a partition from here on
    same, every = Window.partitionBy("__end.key").orderBy("__part"), Window.orderBy("__part")
    tails = ends.select("__part", "__first", F.col("__end.key").alias("__key"), *[(F.sum if k == "sum" else F.bit_xor)(f"__end.{c}").over(same).alias(f"__c{c}") for c, k in values.items()])
    onward = F.lag("__key").over(every).eqNullSafe(F.col("__first"))
    carried = tails.select("__part", F.struct(*[F.when(onward, F.lag(f"__c{c}").over(every)).otherwise(F.lit(0)).alias(c) for c in values]).alias("__c"), "__first")
    whole = parts.join(F.broadcast(carried), "__part")
    more = {c: F.when(group.eqNullSafe(F.col("__first")), F.col(f"__c.{c}")).otherwise(F.lit(0)) for c in values}
    new = {c: (F.col(c) + more[c] if k == "sum" else F.col(c).bitwiseXOR(more[c])).alias(c) for c, k in values.items()}
    kept = [new.get(c, F.col(c)) for c in df.columns]
    return whole.select(*kept, *([(new["__n"] - 1).alias(number)] if number else []))
