"""Properties on generated frames, borders, flat and tiny frames, raw files, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.frames import SCHEMA
from framelake.functions import motion, stack
from framelake.operators import filters, geometry, histograms, joins, objects, points, registration, temporal, user
from framelake.sources import raw_video
from framelake.streaming import live


def frames(spark, arrays, fmt="Y_8", stream="s"):
    rows = [(stream, i, 0, None, a.shape[1], a.shape[0], fmt, [float(v) for v in a.ravel()], (i * 1000,)) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("frame_no") + 1_000_000_000))


def ramp(n, h=6, w=5):
    y, x = np.mgrid[:h, :w]
    return [(x * 7 + y * 13 + k * 29) % 256 for k in range(n)]


def px(df):
    return [np.array(r.px).reshape(r.height, r.width, -1).squeeze(-1) if len(r.px) == r.height * r.width else np.array(r.px) for r in df.orderBy("frame_no").collect()]


def same(a, b):
    return all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_geometry_properties(spark):
    source = ramp(2)
    df = frames(spark, source)
    assert same(px(geometry.flip(geometry.flip(df, True, True), True, True)), source)
    turned = df
    for _ in range(4):
        turned = geometry.rotate90(turned, 1)
    assert same(px(turned), source)
    one = px(geometry.rotate90(df, 1))[0]
    assert one.shape == (5, 6) and np.array_equal(one, np.rot90(source[0], -1))
    assert np.array_equal(px(geometry.crop(df, 1, 2, 3, 2))[1], source[1][2:4, 1:4])


def test_morphology_and_box(spark):
    s = np.stack(ramp(3, 9, 9)).astype(float)[..., None]
    low, high = stack.extreme(s, 3, False)[:, 1:-1, 1:-1], stack.extreme(s, 3, True)[:, 1:-1, 1:-1]
    assert (low <= s[:, 1:-1, 1:-1]).all() and (high >= s[:, 1:-1, 1:-1]).all()
    flat = np.full((1, 7, 7, 1), 9.0)
    assert (stack.box(flat, 3)[:, 1:-1, 1:-1] == 9).all() and (stack.box(flat, 3)[:, 0] == 0).all()
    assert (stack.box(np.ones((1, 1, 1, 1)), 3) == 0).all()
    naive = s[0, 2:5, 3:6, 0].mean()
    assert np.isclose(stack.box(s, 3)[0, 3, 4, 0], naive)
    assert filters.box_sigma(3) == pytest.approx((8 / 12) ** 0.5)


def test_null_border_and_flat_frames(spark):
    flat = [np.full((3, 3), 7)]
    df = frames(spark, flat)
    assert filters.box(df, 3, border="null").head().px[0] is None
    assert px(histograms.auto_contrast(df))[0].max() == 0
    zero = frames(spark, [np.zeros((2, 2))])
    assert same(px(histograms.equalise(zero, 0.5)), [np.zeros((2, 2))])
    assert px(histograms.cdf_equalise(df))[0].min() == 255


def test_pulse_filter_leaves_no_small_region():
    rng = np.random.default_rng(3)
    frame = rng.integers(0, 4, (10, 10)) * 10.0
    out = stack.pulse_filter(frame, 4)
    _, size = np.unique(stack.label_regions(out[:, :-1] == out[:, 1:], out[:-1] == out[1:]), return_counts=True)
    assert size.min() >= 4
    assert np.array_equal(stack.pulse_filter(np.full((5, 5), 3.0), 4), np.full((5, 5), 3.0))


def textured(n=96):
    noise = np.random.default_rng(0).random((1, n, n, 1))
    return stack.gauss_approx(np.pad(noise, ((0, 0), (8, 8), (8, 8), (0, 0)), mode="wrap"), 5, 3)[0, 8:-8, 8:-8, 0] * 10


def test_registration_recovers_a_shift():
    big = textured()
    for dx, dy in ((3, -2), (-4, 5)):
        hx, hy = motion.register(big[8:88, 8:88], big[8 - dy : 88 - dy, 8 - dx : 88 - dx])
        assert abs(hx - dx) < 0.1 and abs(hy - dy) < 0.1
    assert motion.register(big, big) == (0.0, 0.0)


def test_dewarp_keeps_still_frames(spark):
    df = frames(spark, [textured(24)] * 4, "Y_F32")
    assert all(np.allclose(f, textured(24), atol=1e-3) for f in px(registration.dewarp(df)))


@pytest.mark.parametrize("size", [2, 3, 64])
def test_blocked_scan_equals_loop(spark, size):
    source = ramp(7, 2, 2)
    df = frames(spark, source)
    out = temporal.affine_scan(df, F.array(F.lit(0.5)), F.col("px").cast("array<double>"), "x", size).orderBy("frame_no").collect()
    x = np.zeros(4)
    for row, frame in zip(out, source):
        x = 0.5 * x + frame.ravel()
        assert np.allclose(row.x, x, atol=1e-9)


def test_scan_in_tiles_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(temporal, "TILE", 5)
    source = ramp(20, 4, 3)
    df = frames(spark, source)
    rate = F.transform("px", lambda v: 0.25 + (v.cast("int") % 3) / 8)
    out = temporal.affine_scan(df, rate, F.col("px").cast("array<double>"), "x", 4).orderBy("frame_no").collect()
    x = np.zeros(12)
    for row, frame in zip(out, np.array(source).reshape(20, 12).astype(float)):
        x = (0.25 + frame.astype(int) % 3 / 8) * x + frame
        assert np.allclose(row.x, x)


def test_blocks_hold_bounded_bytes(spark, monkeypatch):
    source = ramp(30, 4, 3)
    whole = px(temporal.average(frames(spark, source), 3))
    monkeypatch.setattr(temporal, "BLOCK_BYTES", 6 * 4 * 12)  # six frames a block
    assert same(px(temporal.average(frames(spark, source), 3)), whole)


def test_frames_keep_their_rows_in_histogram_equalisation(spark):
    df = frames(spark, ramp(4, 5, 6))
    for op in (histograms.hist_equalise, histograms.cdf_equalise, histograms.equalize_hist):
        assert "Exchange" not in op(df)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("session", ["UTC", "Europe/Berlin"])
def test_times_survive_grouped_functions(spark, session):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        df = frames(spark, ramp(9, 2, 2)).withColumn("ts", F.timestamp_seconds("frame_no"))
        for out in (temporal.average(df, 1), temporal.background_model(df)):
            assert out.where(F.unix_timestamp("ts") == F.col("frame_no")).count() == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_raw_video_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw_video, "RANGE_BYTES", 14 * 7)  # seven frames a range
    source = ramp(100, 2, 3)
    files = raw_video.write_raw_video(frames(spark, source), str(tmp_path / "raw")).collect()
    assert raw_video.parse(open(files[0].path, "rb").read())[3][99].tolist() == source[99].ravel().tolist()
    assert same(px(raw_video.read_raw_video(spark, files[0].path)), source)


def test_large_unions_are_dropped(spark):
    rects = spark.createDataFrame([("s", 0, i, *r) for i, r in enumerate([(0, 4, 0, 4), (3, 8, 3, 8), (20, 22, 20, 22)])], "stream_id string, frame_no long, rect_id long, l int, r int, t int, b int")
    assert [(r.l, r.r) for r in objects.merge_rects(rects, ["stream_id", "frame_no"], max_width=6).collect()] == [(20, 22)]


def test_retinex_equals_its_formula():
    rng = np.random.default_rng(4)
    v = rng.uniform(0.05, 1, (24, 24))
    g, total = 4, np.zeros((24, 24))
    for scale in range(2):
        k = int(24 / (g * 2**scale)) | 1
        h = k >> 1
        w = np.exp(-((np.arange(k) - h) ** 2) / (2 * (k / 4) ** 2))
        w /= w.sum()
        wide = np.pad(v, h, mode="edge")
        blur = np.array([[sum(w[a] * w[b] * wide[y + a, x + b] for a in range(k) for b in range(k)) for x in range(24)] for y in range(24)])
        r = 3 * (np.log10(v) - np.log10(blur))
        # fewer than 10,000 pixels: no bin is dropped, so the range is that of the centre half, to a bin of 2e-4
        centre = np.clip(r[6:18, 6:18], -1, 1)
        low, high = np.floor((centre.min() + 1) / 2e-4) * 2e-4 - 1, np.floor((centre.max() + 1) / 2e-4) * 2e-4 - 1 + 2e-4
        total += (r - low) / (high - low)
    expected = total / 2 * v / (v + 2.5 / 255)
    assert np.abs(stack.retinex(v[None, :, :, None], g, 2)[0, :, :, 0] - expected).max() < 1e-3


def test_adaptive_average_equals_loop(spark):
    source = np.array(ramp(70, 5, 4))
    out = px(temporal.average_adaptive(frames(spark, source), 0.02))
    x = source[0].astype(float)
    assert np.allclose(out[0], x.reshape(out[0].shape))
    for prev, v, got in zip(source[:-1].astype(float), source[1:].astype(float), out[1:]):
        t = np.clip(np.abs(v - prev) * 0.02, 0.1, 1)
        x = x * (1 - t) + v * t
        assert np.allclose(got, x.reshape(got.shape), atol=1e-3)


def test_average_over_block_borders(spark):
    source = ramp(9, 2, 3)
    out = px(temporal.over_blocks(frames(spark, source), 3, lambda r: np.stack([r[max(0, i - 3) : i + 1].sum(0) / 4 for i in range(len(r))]), size=3))
    whole = px(temporal.average(frames(spark, source), 2))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(out, whole))


def test_raw_video_round_trip(spark, tmp_path):
    source = ramp(300, 2, 3)
    df = frames(spark, source)
    files = raw_video.write_raw_video(df, str(tmp_path / "raw")).collect()
    back = raw_video.read_raw_video(spark, files[0].path)
    assert same(px(back), source) and files[0].bytes == 30 + 300 * (6 + 8) + 1
    content = open(files[0].path, "rb").read()
    assert content[0] == 0xAA and content[-1] == 0x55
    with pytest.raises(ValueError):
        raw_video.parse_header(b"\x00" + content[1:40])
    with pytest.raises(ValueError):
        raw_video.parse(content[:30] + b"\x00" + content[31:])
    raw_video.write_metadata(df, str(tmp_path / "meta"))
    meta = raw_video.read_metadata(spark, str(tmp_path / "meta")).orderBy("frame_no").collect()
    assert [m.meta.ts_ns for m in meta] == [i * 1000 for i in range(300)]
    two = raw_video.read_multi(spark, [files[0].path, files[0].path])
    assert two.count() == 600 and joins.slots(two, 2).count() == 300


def test_recording_of_numbered_images(spark, tmp_path):
    df = frames(spark, ramp(3))
    slots = df.unionByName(df.withColumn("img_no", F.lit(1))).unionByName(df.withColumn("img_no", F.lit(2)))
    names = lambda folder: sorted(p.name for p in folder.iterdir())
    raw_video.write_multi(slots, str(tmp_path / "all"))
    assert names(tmp_path / "all") == [f"s_0{i}.{end}" for i in (1, 2, 3) for end in ("fvf", "meta")]
    raw_video.write_multi(slots, str(tmp_path / "some"), ["left", "", "right"])
    assert names(tmp_path / "some") == ["s_left.fvf", "s_left.meta", "s_right.fvf", "s_right.meta"]
    assert same(px(raw_video.read_raw_video(spark, str(tmp_path / "some" / "s_right.fvf"))), ramp(3))
    assert raw_video.write_multi(slots, str(tmp_path / "none"), ["", "", ""]).count() == 0


def test_pages_past_the_end_and_held_buffer(spark):
    rows = [(f"/d/a{part}.tif", page) for part, n in (("", 2), ("_X2", 3)) for page in range(n)]
    stacked = raw_video.stack_pages(spark.createDataFrame(rows, "path string, page long"))
    wanted = spark.createDataFrame([("a", 1), ("a", 3), ("a", 99)], "base string, position long")
    found = raw_video.pages_at(stacked, wanted).orderBy("position").collect()
    assert [(r.position, r.chunk, r.page) for r in found] == [(1, 1, 1), (3, 2, 1), (99, 2, 2)]
    holds = spark.createDataFrame([(2, 3), (4, 9)], "start_no long, stop_no long")
    last = joins.latest_frame(frames(spark, ramp(6)), holds).collect()
    assert [(r.frame_no, r.seq) for r in last] == [(3, 3)]


def test_disabled_passes_give_their_input(spark):
    df = frames(spark, ramp(1))
    assert filters.box(df, 3, enabled=False) is df and geometry.rotate90(df, enabled=False) is df
    assert same(px(filters.box(df, 3, enabled=True)), px(filters.box(df, 3)))


def test_channel_setup(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<config><channel_setup filename="a" x="1" r="0.5"/><channel_setup filename="b" x="2" r="1"/></config>')
    rows = raw_video.read_channel_setup(spark, str(tmp_path / "c.xml")).orderBy("filename").collect()
    assert [(r.filename, r.x, r.r) for r in rows] == [("a", 1, 0.5), ("b", 2, 1.0)]


def test_rectangles(spark):
    on = np.zeros((6, 8))
    on[1:3, 1:3] = on[4, 6] = 255
    found = objects.components(frames(spark, [on])).orderBy("l").collect()
    assert [(r.l, r.r, r.t, r.b) for r in found] == [(1, 2, 1, 2), (6, 6, 4, 4)]
    assert objects.merged([(0, 4, 0, 4), (3, 8, 3, 8), (20, 22, 20, 22)]) == [(0, 8, 0, 8), (20, 22, 20, 22)]
    assert objects.components(frames(spark, [np.zeros((3, 3))])).count() == 0


def test_formats_must_match(spark):
    a, b = frames(spark, ramp(1)), frames(spark, ramp(1), "Y_F32")
    with pytest.raises(Exception, match="formats differ"):
        joins.diff_and_scale(a, b, 1.0).collect()


def test_empty_tables(spark):
    none = frames(spark, ramp(1)).where("false")
    for op in (lambda d: filters.box(d, 3), histograms.hist_equalise, lambda d: temporal.average(d, 1), geometry.flip, registration.register_pairs, temporal.background_model):
        assert op(none).count() == 0


def test_user_functions(spark):
    df = frames(spark, ramp(2))
    assert same(px(user.apply_frames(df, lambda f: 255 - f)), [255 - f for f in ramp(2)])
    rows = user.frames_to_rows(df, lambda f: [(float(f.max()),)], "top double").collect()
    assert sorted(r.top for r in rows) == sorted(float(f.max()) for f in ramp(2))
    with pytest.raises(ValueError):
        user.Pipeline(a=df).add("a", lambda d: d, "a")


def test_noise_is_repeatable(spark):
    df = frames(spark, ramp(2))
    assert same(px(points.add_noise(df, 0.1, 1)), px(points.add_noise(df, 0.1, 1)))
    assert not same(px(points.add_noise(df, 0.1, 1)), px(points.add_noise(df, 0.1, 2)))


def test_stream_equals_batch(spark, tmp_path):
    df = frames(spark, ramp(8, 2, 2))
    for k in range(4):
        df.where((F.col("frame_no") >= 2 * k) & (F.col("frame_no") < 2 * k + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: raw_video.stream_frames(spark, str(tmp_path / "in"), files=1)

    def run(stream, name):
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name)

    points_out = run(points.threshold_ge(live.ordered(source(), "1 hour"), 100), "live_points")
    assert same(px(points_out), px(points.threshold_ge(df, 100)))
    model = run(live.stream_background(source(), 0.1), "live_model").orderBy("frame_no").collect()
    batch = temporal.background_model(df, 0.1).orderBy("frame_no").collect()
    assert all(np.allclose(a.bg_var, b.bg_var) and np.allclose(a.bg_mean, b.bg_mean) for a, b in zip(model, batch, strict=True))
    moving = run(live.stream_average(source(), 1), "live_average")
    assert all(np.allclose(a, b) for a, b in zip(px(moving), px(temporal.average(df, 1)), strict=True))
    seen = []
    live.keep_latest(source(), lambda batch, n: seen.extend(r.frame_no for r in batch.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "latest")).start().awaitTermination()
    assert len(seen) == 4 and max(seen) == 7


def fed(spark, folder, parts):
    """A stream that brings each of parts as one micro-batch."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return lambda: spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def all_of(stream, folder, name, sink=None):
    made = stream.writeStream.foreachBatch(sink) if sink else stream.writeStream.format("memory").queryName(name).outputMode("append")
    made.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}").start().awaitTermination()
    return None if sink else stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    y, x = np.mgrid[:24, :24].astype(float)
    df = frames(spark, [np.floor(120 + 50 * np.sin((x - k) / 3) + 40 * np.cos(y / 4 + k)) for k in range(8)])
    folder = tmp_path_factory.mktemp("scene")
    return df, fed(spark, folder, [df.where(f"frame_no div 3 = {k}") for k in range(3)]), folder


@pytest.mark.parametrize("name", ["average", "adaptive", "drift", "dewarp"])
def test_stateful_streams_equal_batch(scene, name):
    df, source, folder = scene
    live_form, batch = {
        "average": (lambda d: live.stream_average(d, 2), lambda d: temporal.average(d, 2)),
        "adaptive": (lambda d: live.stream_average_adaptive(d, 0.05, 3), lambda d: temporal.average_adaptive(d, 0.05, 3)),
        "drift": (lambda d: live.stream_equalise_drift(d, 100.0, 0.2), lambda d: histograms.equalise_drift(d, 100.0, 0.2)),
        "dewarp": (lambda d: live.stream_dewarp(d, 0.8), lambda d: registration.dewarp(d, 0.8)),
    }[name]
    found, expected = px(all_of(live_form(source()), folder, f"live_{name}")), px(batch(df))
    assert len(found) == 8 and all(np.allclose(a, b, atol=1e-3) for a, b in zip(found, expected, strict=True))
    assert not np.allclose(expected[7], px(df)[7])


@pytest.mark.parametrize("name, columns", [("average", ["px"]), ("adaptive", ["px"]), ("background", ["px", "bg_mean", "bg_var"]), ("reference", ["px", "ref"])])
def test_streams_in_runs_equal_streams_of_frames(scene, name, columns):
    _, source, folder = scene
    form = {
        "average": lambda d, n: live.stream_average(d, 1, n), "adaptive": lambda d, n: live.stream_average_adaptive(d, 0.05, 3, n),
        "background": lambda d, n: live.stream_background(d, 0.1, n), "reference": lambda d, n: live.stream_reference(d, 0.8, n),
    }[name]
    rows, sizes = [], []

    def sink(batch, number):
        sizes.extend(r.n for r in batch.select(F.size("px").alias("n")).collect())
        rows.extend(live.whole(batch, *columns).collect())

    all_of(form(source(), 100), folder, f"runs_{name}", sink)
    frames_of = all_of(form(source(), 0), folder, f"frames_{name}").orderBy("frame_no").collect()
    assert max(sizes) == 100 and len(sizes) == 8 * 6
    for a, b in zip(sorted(rows, key=lambda r: r.frame_no), frames_of, strict=True):
        assert a.asDict().keys() == b.asDict().keys() and all(np.allclose(a[c], b[c]) for c in columns)


def test_streams_of_cells_and_shifts_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("s", k, 0, x, y, bool(rng.random() < 0.7)) for k in range(9) for x in range(5) for y in range(3)]
    cells = spark.createDataFrame(rows, "stream_id string, frame_no long, img_no int, cell_x int, cell_y int, marked boolean")
    source = fed(spark, tmp_path / "cells", [cells.where(f"frame_no div 4 = {k}") for k in range(3)])
    order = ["frame_no", "cell_x", "cell_y", "run", "detected"]
    found = all_of(live.stream_persistent(source(), 2), tmp_path, "live_cells").select(*order).collect()
    expected = temporal.persistent(cells, 2).select(*order).collect()
    assert sorted(found) == sorted(expected) and any(r.detected for r in found)
    shifts = spark.createDataFrame([("s", k, 0, float(rng.normal()), float(rng.normal())) for k in range(9)], "stream_id string, frame_no long, img_no int, hx double, hy double")
    source = fed(spark, tmp_path / "shifts", [shifts.where(f"frame_no div 2 = {k}") for k in range(5)])
    found = all_of(live.stream_accumulate_shift(source(), 0.9, 0.5), tmp_path, "live_shifts").orderBy("frame_no").collect()
    expected = registration.accumulate_shift(shifts, 0.9, 0.5).orderBy("frame_no").collect()
    assert all(np.allclose(tuple(a[3:]), tuple(b[3:])) for a, b in zip(found, expected, strict=True)) and found[8].cum_hx != 0


def test_late_and_repeated_frames_are_dropped(spark, tmp_path):
    df = frames(spark, ramp(5, 2, 2))
    at = lambda d, hours: d.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {hours} HOURS"))
    parts = [df.where("frame_no < 2"), at(df.where("frame_no = 2"), 3), at(df.where("frame_no = 3"), 3), df.where("frame_no = 4").unionByName(at(df.where("frame_no = 2"), 3))]
    source = fed(spark, tmp_path, parts)
    found = all_of(live.ordered(source(), "1 hour"), tmp_path, "live_late").collect()
    assert sorted(r.frame_no for r in found) == [0, 1, 2, 3]  # 4 came three hours late, 2 twice


def test_streams_of_two_cameras_equal_batch(spark, tmp_path):
    a, b = frames(spark, ramp(6, 3, 3)), frames(spark, [255 - f for f in ramp(6, 3, 3)], stream="other")
    one = fed(spark, tmp_path / "a", [a.where("frame_no < 3"), a.where("frame_no >= 3")])
    two = fed(spark, tmp_path / "b", [b.where("frame_no < 2"), b.where("frame_no >= 2")])
    found = all_of(live.diff_streams(one(), two(), 0.5, "10 seconds"), tmp_path, "live_diff")
    assert same(px(found), px(joins.diff_and_scale(a, b, 0.5)))
    found = all_of(live.gain_streams(one(), two(), 1.5, "10 seconds"), tmp_path, "live_gain")
    assert same(px(found), px(joins.masked_gain(a, b, 1.5)))
    with pytest.raises(Exception, match="formats differ"):
        all_of(live.gain_streams(one(), two().withColumn("pix_fmt", F.lit("Y_16")), 1.5, "10 seconds"), tmp_path, "live_other")


@pytest.fixture(scope="module")
def moving(spark, tmp_path_factory):
    """An embeddings table whose vectors are the 8 x 8 tiles of a smooth scene that moves by (1.5, -1) a frame."""
    rows, y, x = [], *np.mgrid[:32, :32].astype(float)
    for t in range(6):
        u, v = x - 1.5 * t, y + t
        scene = 0.2 * (np.sin(u / 3.0) + np.cos(v / 3.5) + 0.5 * np.sin((u + v) / 5.0))
        rows += [(16 * t + 4 * j + i, scene[8 * j : 8 * j + 8, 8 * i : 8 * i + 8].ravel().tolist(), 0) for j in range(4) for i in range(4)]
    rows += [(96 + i, [0.1 * i] * 64, 0) for i in range(3)]  # the last frame of the stream isn't full
    path = tmp_path_factory.mktemp("moving")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_tiled_frames_hold_every_vector(spark, moving):
    from framelake.frames import from_embeddings, tiled

    small = {r.frame_no: np.array(r.px).reshape(8, 8) for r in from_embeddings(spark, moving).collect()}
    large = {r.frame_no: r for r in tiled(from_embeddings(spark, moving)).collect()}
    assert sorted(large) == list(range(7)) and len(small) == 99
    for t, r in large.items():
        frame = np.array(r.px).reshape(r.height, r.width)
        for k in range(16):
            assert (frame[8 * (k // 4) : 8 * (k // 4) + 8, 8 * (k % 4) : 8 * (k % 4) + 8] == small.get(16 * t + k, 128)).all()


@pytest.mark.parametrize("name, off", [("f14_register_pairs", 0.4), ("f17_register_rois", 0.6)])
def test_registered_queries_recover_shifts(spark, moving, name, off):
    from framelake.queries import QUERIES

    found = {r.frame_no: (r.hx, r.hy) for r in QUERIES[name](spark, moving).collect()}
    for t in range(1, 6):
        assert abs(found[t][0] + 1.5) < off and abs(found[t][1] - 1) < off


def test_workloads_of_registered_queries_move_frames(spark, moving):
    from framelake.frames import from_embeddings, tiled
    from framelake.queries import QUERIES

    shifts = registration.accumulate_shift(registration.register_pairs(points.to_y_f32(tiled(from_embeddings(spark, moving)))))
    assert all(abs(r.cum_hx) > 0.5 for r in shifts.where("frame_no in (3, 4, 5)").collect())
    detected = QUERIES["w1_motion_detection"](spark, moving).collect()
    assert len(detected) == 7 and all(len(r.px.split(",")) == 1024 for r in detected)
    assert QUERIES["w2_enhancement"](spark, moving).count() == 7 * 1024
