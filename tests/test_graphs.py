"""Merged rectangles and the pulse filter against literal loops."""

import time

import numpy as np
import pytest

from framelake.functions import stack
from framelake.operators import objects


def loop_merged(boxes):
    boxes = list(boxes)
    reach = lambda b: [((b[i] + b[i + 1]) // 2 - (b[i + 1] - b[i]) // 2, (b[i] + b[i + 1]) // 2 + (b[i + 1] - b[i]) // 2) for i in (0, 2)]
    while True:
        group = list(range(len(boxes)))
        for _ in boxes:
            for i, a in enumerate(boxes):
                for j, b in enumerate(boxes):
                    if all(p[0] <= q[1] and q[0] <= p[1] for p, q in zip(reach(a), reach(b))):
                        group[i] = group[j] = min(group[i], group[j])
        new = []
        for g in sorted(set(group)):
            own = [b for b, k in zip(boxes, group) if k == g]
            new.append((min(b[0] for b in own), max(b[1] for b in own), min(b[2] for b in own), max(b[3] for b in own)))
        if len(new) == len(boxes):
            return sorted(new)
        boxes = new


@pytest.mark.parametrize("seed", range(12))
def test_merged_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    l, t = rng.integers(-20, 160, (2, n))
    w, h = rng.integers(0, [4, 12, 30][seed % 3], (2, n))
    boxes = [tuple(map(int, b)) for b in zip(l, l + w, t, t + h)]
    boxes += boxes[:2]
    assert sorted(objects.merged(boxes)) == loop_merged(boxes)
    assert objects.merged([]) == []


def test_very_many_rectangles_in_a_frame():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40_000, (2, 100_000))
    began = time.time()
    few = objects.merged([(a, a + 20, b, b + 20) for a, b in zip(x.tolist(), y.tolist())])
    dense = objects.merged([(a, a + 4000, b, b + 4000) for a, b in zip(x.tolist(), y.tolist())])
    assert 50_000 < len(few) < 100_000 and len(dense) == 1 and time.time() - began < 60


def loop_pulse(v, p):
    v, (h, w) = v.astype(float).copy(), v.shape
    reached = 0
    while True:
        label, regions = -np.ones((h, w), int), []
        for y in range(h):
            for x in range(w):
                if label[y, x] < 0:
                    todo, own = [(y, x)], []
                    label[y, x] = len(regions)
                    while todo:
                        a, b = todo.pop()
                        own.append((a, b))
                        for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                            if 0 <= c < h and 0 <= d < w and label[c, d] < 0 and v[c, d] == v[y, x]:
                                label[c, d] = len(regions)
                                todo.append((c, d))
                    regions.append(own)
        if reached >= p or len(regions) == 1:
            return v
        reached = min(map(len, regions))
        value = [v[own[0]] for own in regions]
        for k, own in enumerate(regions):
            if len(own) == reached:
                around = sorted({int(label[c, d]) for a, b in own for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)) if 0 <= c < h and 0 <= d < w} - {k})
                best = None
                for x in around:
                    if best is None or abs(value[x] - value[k]) <= abs(value[best] - value[k]):
                        best = x
                value[k] = value[best]
        for k, own in enumerate(regions):
            for at in own:
                v[at] = value[k]


@pytest.mark.parametrize("seed", range(15))
def test_pulse_filter_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, [2, 4, 9][seed % 3], (int(rng.integers(1, 12)), int(rng.integers(2, 14)))).astype(float)
    for p in (1, 2, 4, 9, 1000):
        assert np.array_equal(stack.pulse_filter(v, p), loop_pulse(v, p)), p


def test_the_round_that_reaches_the_size_is_applied():
    v = np.array([[5, 5, 5, 9, 9, 9, 9]], float)
    assert stack.pulse_filter(v, 3).tolist() == [[9] * 7] and stack.pulse_filter(v, 0).tolist() == v.tolist()


def test_a_whole_frame_in_seconds():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:480, :640]
    v = np.floor((np.sin(x / 40) * np.cos(y / 30) + rng.normal(0, 0.2, y.shape)) * 4) * 10
    began = time.time()
    out = stack.pulse_filter(v, 30)
    assert len(np.unique(stack.label_regions(out[:, :-1] == out[:, 1:], out[:-1] == out[1:]))) < 2000 and time.time() - began < 60


@pytest.mark.parametrize(("h", "w", "tiles", "clip"), [(16, 24, 4, 2.0), (13, 17, 3, 1.2), (5, 4, 8, 40.0)])
def test_clahe_equals_a_loop(h, w, tiles, clip):
    """Each pixel looks its value up in the clipped distributions of the four tiles whose centres lie around it."""
    v = np.random.default_rng(h).integers(0, 200, (h, w))
    ny, nx = min(tiles, h), min(tiles, w)
    cut = lambda n, k: [int(n * i / k) for i in range(k + 1)]
    ys, xs = cut(h, ny), cut(w, nx)

    def table(a, b):
        values = [v[y, x] for y in range(ys[a], ys[a + 1]) for x in range(xs[b], xs[b + 1])]
        most = max(1.0, clip * len(values) / 256)
        counts = [values.count(k) for k in range(256)]
        over = sum(max(0.0, c - most) for c in counts) / 256
        return [sum(min(c, most) + over for c in counts[: k + 1]) * 255 / len(values) for k in range(256)]

    tables = [[table(a, b) for b in range(nx)] for a in range(ny)]

    def around(at, edges):
        """(tile, weight) of the centres on both sides; beyond the outer centres the outer tile alone."""
        centres = [(p + q - 1) / 2 for p, q in zip(edges, edges[1:])]
        if at <= centres[0]:
            return [(0, 1.0)]
        for k in range(len(centres) - 1):
            if centres[k] <= at < centres[k + 1]:
                f = (at - centres[k]) / (centres[k + 1] - centres[k])
                return [(k, 1 - f), (k + 1, f)]
        return [(len(centres) - 1, 1.0)]

    found = stack.clahe(v[None, :, :, None].astype(float), clip, tiles)[0, :, :, 0]
    for y in range(h):
        for x in range(w):
            value = sum(f * g * tables[a][b][v[y, x]] for a, f in around(y, ys) for b, g in around(x, xs))
            assert abs(found[y, x] - min(255, max(0, np.floor(value + 0.5)))) <= (abs(value + 0.5 - round(value + 0.5)) < 1e-6)


def test_many_frames_at_once_merge_as_each_alone(spark):
    """Small frames go through a task together, which takes less than a fourth of a loop over them."""
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 8, 100), [16, 17, 30, 1, 40]])
    frame = np.repeat(np.arange(len(sizes)), sizes)
    l, t, w, h = rng.integers(0, 100, len(frame)), rng.integers(-50, 50, len(frame)), rng.integers(0, 40, len(frame)), rng.integers(0, 40, len(frame))
    rows = [("s", int(f), 0, *map(int, box)) for f, *box in zip(frame, l, l + w, t, t + h)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("10000", "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            found = objects.merge_rects(spark.createDataFrame(rows, "stream_id string, frame_no long, img_no int, l int, r int, t int, b int")).collect()
            wanted = [("s", k, 0, n, *box) for k in range(len(sizes)) for n, box in enumerate(loop_merged([r[3:] for r in rows if r[1] == k]))]
            assert sorted(map(tuple, found)) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    box = np.stack([l, l + w, t, t + h], 1)[frame < 100].astype(np.int64)
    few, start = frame[frame < 100], time.perf_counter()
    objects.merged_small(np.concatenate([few + 100 * k for k in range(50)]), np.tile(box, (50, 1)))
    together = time.perf_counter() - start
    start = time.perf_counter()
    for k in range(100):
        objects.merged(list(map(tuple, box[few == k].tolist())))
    assert together < 50 * (time.perf_counter() - start) / 4
