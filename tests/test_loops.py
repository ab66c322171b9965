"""Operators at general settings (fractions, turns, colour, several passes) against plain loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.frames import SCHEMA
from framelake.functions import stack
from framelake.operators import filters, geometry, joins, points, registration


def frames(spark, arrays, fmt="Y_8"):
    rows = [("s", i, 0, None, a.shape[1], a.shape[0], fmt, [float(v) for v in a.ravel()], None) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, SCHEMA)


def images(df, channels=1):
    return [np.array(r.px, float).reshape(r.height, r.width, channels) for r in df.orderBy("frame_no").collect()]


def some(n, h, w, c=1, seed=5):
    return [a for a in np.random.default_rng(seed).integers(0, 256, (n, h, w, c)).astype(float)]


def at(frame, x, y):
    h, w = frame.shape[:2]
    return frame[y, x] if 0 <= x < w and 0 <= y < h else np.zeros(frame.shape[2])


def drawn(frame, source):
    """Each output pixel from source(x, y)."""
    h, w = frame.shape[:2]
    return np.array([[source(x, y) for x in range(w)] for y in range(h)])


def between(frame, x, y):
    h, w = frame.shape[:2]
    if not (0 <= x <= w - 1 and 0 <= y <= h - 1):
        return np.zeros(frame.shape[2])
    x0, y0 = math.floor(x), math.floor(y)
    fx, fy = x - x0, y - y0
    weights = {(x0, y0): (1 - fx) * (1 - fy), (x0 + 1, y0): fx * (1 - fy), (x0, y0 + 1): (1 - fx) * fy, (x0 + 1, y0 + 1): fx * fy}
    return sum(k * at(frame, *p) for p, k in weights.items())


@pytest.mark.parametrize("k, n", [(3, 3), (5, 2), (3, 1)])
def test_repeated_boxes(spark, k, n):
    arrays = some(2, 11, 9)
    h = k // 2

    def box(frame):
        inside = lambda x, y: h <= x < 9 - h and h <= y < 11 - h
        return drawn(frame, lambda x, y: frame[y - h : y + h + 1, x - h : x + h + 1].mean((0, 1)) if inside(x, y) else np.zeros(1))

    for got, frame in zip(images(filters.gauss_approx(points.to_y_f32(frames(spark, arrays)), k, n)), images(points.to_y_f32(frames(spark, arrays)))):
        for _ in range(n):
            frame = box(frame)
        assert np.abs(got - frame).max() < 1e-5


@pytest.mark.parametrize("m", [[[1.5, 0.5], [-0.25, 1.0]], [[0.6, -0.8], [0.8, 0.6]], [[-1, 0], [0, 2]]])
def test_affine_with_shear_and_turn(spark, m):
    arrays = some(2, 8, 10, 3)
    (a, b), (c, d) = m
    det = a * d - b * c
    for got, frame in zip(images(geometry.affine(frames(spark, arrays, "RGB_8"), m), 3), arrays):
        assert np.array_equal(got, drawn(frame, lambda x, y: at(frame, math.floor((x * d - y * b) / det + 0.5), math.floor((y * a - x * c) / det + 0.5))))


def test_stabilise_between_pixels(spark):
    arrays = some(4, 9, 12)
    shifts = [(0.0, 0.0), (0.25, -0.5), (-1.75, 2.0), (30.0, 0.0)]
    moves = spark.createDataFrame([("s", i, 0, *c) for i, c in enumerate(shifts)], "stream_id string, frame_no long, img_no int, cum_hx double, cum_hy double")
    df = points.to_y_f32(frames(spark, arrays))
    for got, frame, (cx, cy) in zip(images(registration.stabilise(df, moves, "subpixel")), images(df), shifts, strict=True):
        assert np.abs(got - drawn(frame, lambda x, y: between(frame, x - cx, y - cy))).max() < 1e-6
    assert np.array_equal(images(registration.stabilise(df, moves, "none")), images(df))


def test_fuse_with_turn_scale_and_weights(spark):
    arrays = some(3, 10, 8)
    setup = [(0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.5), (1, 1.5, -2.0, 1.25, 30.0, 0.25, 1.0, 0.0), (2, -1.0, 0.5, 0.5, -75.0, 0.0, 0.5, 2.0)]
    df = points.to_y_f32(frames(spark, arrays)).withColumn("img_no", F.col("frame_no").cast("int")).withColumn("frame_no", F.lit(0).cast("long"))
    cameras = [np.array(r.px).reshape(10, 8, 1) for r in df.orderBy("img_no").collect()]
    got = images(joins.fuse(df, spark.createDataFrame(setup, "img_no int, x double, y double, scale double, angle double, r double, g double, b double")), 3)
    total = np.zeros((10, 8, 3))
    for frame, (_, sx, sy, scale, angle, *weights) in zip(cameras, setup):
        cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))

        def source(x, y):
            u, v = (x - 4 - sx) / scale, (y - 5 - sy) / scale
            return at(frame, math.floor(u * cos + v * sin + 4.5), math.floor(v * cos - u * sin + 5.5))

        total += drawn(frame, source) * np.array(weights)
    assert len(got) == 1 and np.abs(got[0] - total).max() < 1e-5


@pytest.mark.parametrize("mean", [(104, 117, 123), (0, 1, 2)])
def test_model_input_of_colour_frames(spark, mean):
    arrays = some(2, 7, 9, 3)
    out = points.prepare_input(frames(spark, arrays, "RGB_8"), 4, 5, mean).orderBy("frame_no").collect()
    for r, frame in zip(out, arrays):
        small = np.array([[frame[y * 7 // 5, x * 9 // 4] for x in range(4)] for y in range(5)])
        assert (r.width, r.height) == (4, 5)
        assert np.array_equal(np.array(r.px).reshape(3, 5, 4), np.moveaxis(small[..., ::-1] - np.array(mean), -1, 0))  # planes B, G, R


def test_noise_stays_in_its_range(spark):
    arrays = [np.full((16, 16, 1), v) for v in (0.0, 100.0, 250.0)]
    for got, frame in zip(images(points.add_noise(frames(spark, arrays), 0.1, 3)), arrays):
        added = got - frame
        assert (added == np.floor(added)).all() and added.min() >= 0 and got.max() <= 255
        assert added.max() <= 26 and (frame[0, 0, 0] == 250 or 11 < added.mean() < 15)  # 0 to 25.5, even


@pytest.mark.parametrize("blur", ["box", "gauss"])
def test_retinex_of_colour(blur):
    """Three box passes over repeated edges; colour keeps 2.5 times its distance from grey. Under 10,000 pixels no bin is dropped."""
    rng = np.random.default_rng(4)
    v = rng.uniform(0.05, 1, (20, 20, 3))
    grey, g, total = v.mean(-1), 4, np.zeros((20, 20))
    for scale in range(2):
        k = int(20 / (g * 2**scale)) | 1
        h = k >> 1
        one = np.full(k, 1 / k) if blur == "box" else np.exp(-((np.arange(k) - h) ** 2) / (2 * (k / 4) ** 2))
        one /= one.sum()
        smooth = grey
        for _ in range(3 if blur == "box" else 1):
            wide = np.pad(smooth, h, mode="edge")
            smooth = np.array([[sum(one[a] * one[b] * wide[y + a, x + b] for a in range(k) for b in range(k)) for x in range(20)] for y in range(20)])
        r = 3 * (np.log10(grey) - np.log10(smooth))
        centre = np.clip(r[5:15, 5:15], -1, 1)
        low, high = np.floor((centre.min() + 1) / 2e-4) * 2e-4 - 1, np.floor((centre.max() + 1) / 2e-4) * 2e-4 - 1 + 2e-4
        total += (r - low) / (high - low)
    gain = (total / 2 / (grey + 2.5 / 255))[..., None]
    expected = gain * v + 2.5 * (v - grey[..., None])
    assert np.abs(stack.retinex(v[None], g, 2, blur)[0] - expected).max() < 1e-3
