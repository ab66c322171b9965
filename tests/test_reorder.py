"""Shuffled arrival inside the delay gives what order gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import temporal
from framelake.streaming import live, reorder

from .test_frames import all_of, fed, frames, px, ramp, same


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, reorder.STORE)
    yield
    spark.conf.set(name, held)


def test_frames_come_out_in_order(spark, tmp_path, store):
    source = ramp(12, 3, 4)
    df = frames(spark, source).unionByName(frames(spark, [255 - a for a in source], stream="t"))
    arrival = [[3, 0], [1, 4], [2, 2, 5], [8, 6], [7, 9, 3], [11, 10]]
    parts = [df.where(F.col("frame_no").isin(own)).unionByName(df.where(F.col("frame_no").isin([n for n in own if own.count(n) > 1]))) for own in arrival]
    end = frames(spark, [np.zeros((3, 4))] * 2).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS")).withColumn("stream_id", F.lit("end"))
    parts += [end.where("frame_no = 0"), end.where("frame_no = 1"), df.where("frame_no = 1")]  # frame 1 again, hours late
    taken = []
    stream = reorder.reordered(fed(spark, tmp_path, parts)(), "4 seconds")
    all_of(stream, tmp_path, "in_order", lambda batch, n: taken.extend((n, r) for r in batch.collect()))
    for name, arrays in (("s", source), ("t", [255 - a for a in source])):
        own = [(n, r) for n, r in taken if r.stream_id == name]
        assert sorted(r.frame_no for _, r in own) == list(range(12))
        order = sorted(own, key=lambda x: x[1].frame_no)
        assert [n for n, _ in order] == sorted(n for n, _ in own)  # no batch brings what an earlier one should have
        assert same([np.array(r.px).reshape(3, 4) for _, r in order], arrays) and order[3][1].meta.ts_ns == 3000
    out = spark.createDataFrame([r for _, r in taken], df.schema)
    out.write.partitionBy().parquet(str(tmp_path / "kept"))
    batches = {}
    for n, r in taken:
        batches.setdefault(n, []).append(r)
    again = fed(spark, tmp_path / "again", [spark.createDataFrame(rows, df.schema) for _, rows in sorted(batches.items())])
    found = all_of(live.stream_average(again().where("stream_id = 's'"), 2), tmp_path, "average_in_order")
    assert all(np.allclose(a, b) for a, b in zip(px(found), px(temporal.average(frames(spark, source), 2)), strict=True))
