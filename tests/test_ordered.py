"""Numbers and running values inside groups, whatever a group's share of the rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from framelake.functions.ordered import running


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_running_equals_a_loop(spark, parts, batch):
    rows = [(None if g == 3 else f"g{g}", i, i * 31 % 17 - 5, i * 1_000_003 - (1 << 40)) for g, n in enumerate((1, 300, 2, 40, 0, 5)) for i in range(n)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        table = spark.createDataFrame(rows, "g string, o long, s long, x long").orderBy(F.rand(1))
        found = running(table, ["g"], ["o"], number="at", sums=["s"], xors=["x"]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by, expected = defaultdict(lambda: [0, 0, 0]), []
    for g, o, s, x in rows:
        held = by[g]
        held[1], held[2] = held[1] + s, held[2] ^ x
        expected.append((g, o, held[1], held[2], held[0]))
        held[0] += 1
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected))
    assert running(table.where("false"), ["g"], ["o"], number="at").count() == 0


def test_groups_stay_in_one_task_after_a_join_by_their_key(spark):
    """Spark turns such a join into a broadcast at run time and reads the shuffle before it in pieces."""
    import pyarrow as pa
    from pyspark import TaskContext

    from framelake.functions.ordered import grouped

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([TaskContext.get().partitionId()] * batch.num_rows)], names=["k", "task"])

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        rows = spark.range(0, 4000, 1, 6).select("id", (F.col("id") % 50).alias("k"))
        joined = rows.join(rows.groupBy("k").agg(F.max("id").alias("last")), ["k"])
        tasks = grouped(joined, ["k"], ["id"]).mapInArrow(run, "k long, task long").groupBy("k").agg(F.countDistinct("task").alias("n"))
        assert {r.n for r in tasks.collect()} == {1}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
