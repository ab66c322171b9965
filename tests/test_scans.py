"""Nested recursions over blocks against loops: several blocks, values in pieces, one shuffle of frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import motion as flow
from framelake.operators import registration, temporal

from .test_frames import frames, px


def moving(n, h=24, w=30):
    """A textured scene that moves and turns dark."""
    y, x = np.mgrid[:h, :w]
    return [np.floor(128 + 60 * np.sin((x - k * 0.7) / 3) * np.cos((y + k * 0.4) / 4) + 30 * np.sin((x + 2 * y) / 5 - k)).clip(0, 255) for k in range(n)]


@pytest.fixture(params=[(3, 100), (64, 1 << 16), (1, 7)])
def pieces(request, monkeypatch):
    size, some = request.param
    monkeypatch.setattr(temporal, "BLOCK", size)
    monkeypatch.setattr(temporal, "block_frames", lambda size_=None: F.lit(size_ or size))
    monkeypatch.setattr(temporal, "SOME", some)
    monkeypatch.setattr(temporal, "TILE", 64)


def test_background_and_cells(spark, pieces):
    source = moving(11)
    df = frames(spark, source).withColumn("note", F.col("frame_no") * 2)
    mean, var, expected = None, None, []
    for v in source:
        mean = v if mean is None else mean * 0.9 + v * 0.1
        var = np.full(v.shape, 100.0) if var is None else var * 0.9 + (np.floor(v) - np.floor(mean)) ** 2 * 0.1
        expected.append((mean, var, np.abs(v - mean) / np.sqrt(var) > 1.2))
    model = temporal.background_model(df, 0.1)
    for r, (m, s, _) in zip(model.orderBy("frame_no").collect(), expected, strict=True):
        assert np.abs(np.array(r.bg_mean) - m.ravel()).max() < 1e-9 and np.abs(np.array(r.bg_var) - s.ravel()).max() < 1e-9 and r.note == 2 * r.frame_no
    cells = sorted((n, int(x), int(y), bool(hit[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].any())) for n, (_, _, hit) in enumerate(expected) for y in range(3) for x in range(4))
    for found in (temporal.motion(df, 0.1, 1.2, 8), temporal.motion_cells(model, 1.2, 8)):
        assert sorted((r.frame_no, r.cell_x, r.cell_y, r.marked) for r in found.collect()) == cells
    plan = temporal.motion(df, 0.1, 1.2, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "px" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert temporal.motion(df.where("false")).count() == 0


def test_adaptive_average_with_a_blur(spark, pieces):
    source = moving(8)

    def blur(v, k=3):
        for _ in range(2):
            wide = np.pad(v, 1)
            v = sum(wide[a : a + v.shape[0], b : b + v.shape[1]] for a in range(k) for b in range(k)) / k**2
            v[0], v[-1], v[:, 0], v[:, -1] = (0,) * 4
        return v

    out, expected, past = None, [], None
    for v in source:
        now = temporal.blurred(v[None, :, :, None].astype(float), 3)[0, :, :, 0]
        inner = blur(v.astype(float))[2:-2, 2:-2]
        assert np.abs(now[2:-2, 2:-2] - inner).max() < 1e-9
        t = np.ones(v.shape) if past is None else np.clip(np.abs(now - past) * 0.05, 0.1, 1)
        out, past = (v * t if out is None else (1 - t) * out + t * v), now
        expected.append(out)
    found = px(temporal.average_adaptive(frames(spark, source), 0.05, 3))
    assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(found, expected, strict=True))


def test_dewarp_of_a_moving_scene_equals_a_loop(spark, pieces):
    source = moving(7)
    ref, expected = np.zeros(source[0].shape), []
    for n, v in enumerate(source):
        keep = 0.0 if n < 3 else 0.95
        ref = keep * ref + (1 - keep) * source[max(0, n - 1)]
        expected.append(flow.warp(v[:, :, None].astype(float), *flow.dense_flow(v.astype(float), ref), 0.0)[:, :, 0])
    found = px(registration.dewarp(frames(spark, source)))
    assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(found, expected, strict=True))
    assert any(np.abs(a - v).max() > 1 for a, v in zip(expected[3:], source[3:]))  # the scene is drawn somewhere


def test_runs_of_marks_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    rows = [("s" if c < 3 else None, n, 0, c, 1, bool(m) if m < 2 else None) for c in range(5) for n, m in enumerate(rng.choice(3, 120, p=[0.15, 0.8, 0.05]))]
    cells = spark.createDataFrame(rows, temporal.CELLS)
    found = {(r.cell_x, r.frame_no): (r.run, r.detected) for r in temporal.persistent(cells.repartition(5), 3).collect()}
    for c in range(5):
        run = 0
        for _, n, _, _, _, marked in (r for r in rows if r[3] == c):
            run = run + 1 if marked else 0
            assert found[c, n] == (run, run > 3)
    assert temporal.persistent(cells.where("false")).count() == 0
