"""Interval and box joins against loops."""

import numpy as np
from pyspark.sql import functions as F

from framelake.operators import joins, ranges


def test_points_in_intervals_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    spans = [(int(a), int(a + d)) for a, d in zip(rng.integers(-50, 5000, 300), rng.integers(-2, 30, 300))] + [(None, 9), (4, None), (6000, 1 << 62), (-(1 << 40), -900)]
    points = [int(p) for p in rng.integers(-1000, 6100, 900)] + [None, 5999, 6000, -900, -901]
    df = spark.createDataFrame([(f"s{i % 3}", 0, p) for i, p in enumerate(points + points[:50])], "stream_id string, img_no int, frame_no long")
    intervals = spark.createDataFrame(spans, "start_no long, stop_no long")
    inside = lambda p: p is not None and any(a is not None and b is not None and a <= p < b for a, b in spans)
    found = joins.record_between(df, intervals)
    assert sorted(r.frame_no for r in found.collect()) == sorted(p for p in points + points[:50] if inside(p))
    held = joins.latest_frame(df, intervals).agg(F.sum("seq")).first()[0]
    assert held == sum(not inside(p) for p in points + points[:50])
    assert joins.record_between(df, intervals.where("false")).count() == 0 and joins.record_between(df.where("false"), intervals).count() == 0
    for plan in (found, joins.latest_frame(df, intervals)):
        assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


def test_touching_boxes_equal_a_loop(spark):
    rng = np.random.default_rng(7)

    def boxes(n, most):
        l, t = rng.integers(-300, 3000, (2, n))
        w, h = (rng.integers(1, most, (2, n)) ** rng.choice([0.3, 1.0], n)).astype(int)
        return [(int(a), int(a + c), int(b), int(b + d)) for a, b, c, d in zip(l, t, w, h)]

    a = boxes(300, 300) + [(0, 0, 0, 0), (5, 4, 0, 9), (None, 3, 0, 3), (-(1 << 31), (1 << 31) - 1, 7, 7)]
    b = boxes(60, 60) + [(16, 16, 16, 16), (256, 511, 0, 15), (2900, 2100, 0, 4000)]
    a += a[:20]
    schema = "l int, r int, t int, b int"
    hit = lambda x, y: None not in x and x[0] <= x[1] and x[2] <= x[3] and y[0] <= y[1] and y[2] <= y[3] and x[0] <= y[1] and x[1] >= y[0] and x[2] <= y[3] and x[3] >= y[2]
    found = joins.in_roi(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert sorted(map(tuple, found.collect())) == sorted(x for x in a if any(hit(x, y) for y in b))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert ranges.touching(spark.createDataFrame(a, schema), spark.createDataFrame([], schema)).count() == 0
