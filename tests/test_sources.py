"""Raw video as a data source: names, frame ranges, commit and abort, streams; side files of any layout."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import raw_video, video_format

from .test_frames import frames, px, ramp, same


def test_streams_with_similar_names_keep_their_frames(spark, tmp_path):
    streams = ["cam a", "cam_a", "cam/a", "cam%20a", "cäm", "", "a_01"]
    df = None
    for k, stream in enumerate(streams):
        one = frames(spark, [a + k for a in ramp(5)], stream=stream)
        df = one if df is None else df.unionByName(one)
    files = raw_video.write_raw_video(df, str(tmp_path / "v"))
    assert files.count() == len(streams) == len(os.listdir(tmp_path / "v"))
    assert sorted(r.bytes for r in files.collect()) == [30 + 5 * 38 + 1] * len(streams)
    for reader in (video_format.read_video, raw_video.read_raw_video):
        back = reader(spark, str(tmp_path / "v"))
        assert back.count() == 5 * len(streams)
        for k, stream in enumerate(streams):
            assert same(px(back.where(F.col("stream_id") == stream + "_01")), [a + k for a in ramp(5)])
    assert video_format.file_name("a", 0, name="b_c") != video_format.file_name("a_b", 0, name="c")


def test_only_wanted_ranges_are_read(spark, tmp_path, monkeypatch):
    raw_video.write_raw_video(frames(spark, ramp(100, 2, 3)), str(tmp_path / "v"))
    path = str(tmp_path / "v" / "s_01.fvf")
    monkeypatch.setattr(raw_video, "RANGE_BYTES", 14 * 7)
    read = []
    true = raw_video.bytes_at
    monkeypatch.setattr(raw_video, "bytes_at", lambda p, start, n: read.append((start, n)) or true(p, start, n))
    reader = video_format.PushedReader(path, 0, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    other = EqualTo(("width",), 3)
    assert list(reader.pushFilters([GreaterThan(("frame_no",), 39), other, LessThanOrEqual(("frame_no",), 45)])) == [other]
    got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("frame_no").to_pylist()]
    assert got == list(range(40, 46)) and read == [(0, 4096), (30 + 40 * 14, 6 * 14)]
    monkeypatch.undo()
    assert [r.frame_no for r in video_format.read_video(spark, path, 98).collect()] == [98, 99]
    held = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        some = video_format.read_video(spark, str(tmp_path / "v" / "*.fvf")).where("frame_no BETWEEN 90 AND 92 AND width = 3")
        assert same(px(some), ramp(100, 2, 3)[90:93])
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", held)


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    video_format.register(spark)
    good = frames(spark, ramp(6))
    write = lambda df, mode="append": df.select("stream_id", "img_no", "frame_no", "width", "height", "pix_fmt", "px").write.format("rawvideo").mode(mode).save(str(tmp_path / "v"))
    broken = good.withColumn("px", F.when(F.col("frame_no") == 4, F.raise_error("lost")).otherwise(F.col("px")))
    for bad in (broken, good.where("frame_no <> 2"), good.unionByName(good.where("frame_no = 1")), good.withColumn("width", F.lit(7))):
        with pytest.raises(Exception):  # noqa: B017
            write(bad)
        assert os.listdir(tmp_path / "v") == []
    write(good)
    write(frames(spark, ramp(2)))  # a shorter video keeps nothing of the longer one
    assert same(px(video_format.read_video(spark, str(tmp_path / "v"))), ramp(2))
    write(frames(spark, ramp(3), stream="t"), "overwrite")
    assert os.listdir(tmp_path / "v") == ["t_01.fvf"]
    with pytest.raises(ValueError, match="mounted"):
        raw_video.write_raw_video(good, "s3a://bucket/v")
    gaps = good.where("frame_no IN (1, 4, 5)")  # numbers with gaps are made consecutive
    raw_video.write_raw_video(gaps, str(tmp_path / "gaps"))
    assert same(px(raw_video.read_raw_video(spark, str(tmp_path / "gaps"))), [ramp(6)[i] for i in (1, 4, 5)])


@pytest.mark.parametrize("layout", ["ts_ns:u64", "ts_ns:i64,lat:f64,flags:u16", "gain:f32"])
def test_records_of_any_layout(spark, tmp_path, layout):
    fields = [f.split(":") for f in layout.split(",")]
    df = frames(spark, ramp(9)).withColumn("meta", F.struct(*[(F.col("frame_no") * (k + 2)).alias(name) for k, (name, _) in enumerate(fields)]))
    raw_video.write_metadata(df.withColumn("meta", F.when(F.col("frame_no") != 3, F.col("meta"))), str(tmp_path / "m"), layout=layout)
    assert os.path.getsize(tmp_path / "m" / "s_01.meta") == 9 * raw_video.record_type(layout).itemsize
    found = raw_video.read_metadata(spark, str(tmp_path / "m"), layout).orderBy("frame_no").collect()
    assert [tuple(r.meta) for r in found] == [tuple((i * (k + 2) if i != 3 else 0) for k in range(len(fields))) for i in range(9)]


def test_videos_arrive_as_a_stream(spark, tmp_path):
    raw_video.write_raw_video(frames(spark, ramp(4)), str(tmp_path / "v"))

    def run():
        stream = video_format.stream_video(spark, str(tmp_path / "v")).select("stream_id", "frame_no", F.element_at("px", 2).alias("v"))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "held")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    first = [("s_01", i, float(a[0, 1])) for i, a in enumerate(ramp(4))]
    assert run() == first
    raw_video.write_raw_video(frames(spark, ramp(2), stream="t"), str(tmp_path / "v"))
    assert run() == first + [("t_01", i, float(np.asarray(a)[0, 1])) for i, a in enumerate(ramp(2))]


def hand_made(order, pages, rows_per_strip=2):
    """A stack with several strips a page, directories after the pixels, the second page's first in the file."""
    from framelake.sources.page_stacks import VERSION

    body, places = bytearray((b"II" if order == "<" else b"MM") + np.array([VERSION], order + "u2").tobytes() + bytes(4)), {}
    for k in reversed(range(len(pages))):
        h, w = pages[k].shape
        strips = [pages[k][i : i + rows_per_strip] for i in range(0, h, rows_per_strip)]
        offsets = []
        for s in strips:
            offsets.append(len(body))
            body += s.astype(order + "u2").tobytes()
        tables = []
        for values in (offsets, [2 * s.size for s in strips]):
            tables.append((len(body) if len(values) > 1 else values[0], len(values)))
            if len(values) > 1:
                body += np.array(values, order + "u4").tobytes()
        short = lambda v: np.array([v, 0], order + "u2").tobytes()
        long = lambda v: np.array([v], order + "u4").tobytes()
        fields = [(256, 3, 1, short(w)), (257, 4, 1, long(h)), (258, 3, 1, short(16)), (270, 2, 3, b"ab\x00\x00"), (273, 4, tables[0][1], long(tables[0][0])), (278, 3, 1, short(rows_per_strip)), (279, 4, tables[1][1], long(tables[1][0]))]
        places[k] = len(body)
        body += np.array([len(fields)], order + "u2").tobytes()
        for tag, kind, n, value in fields:
            body += np.array([tag, kind], order + "u2").tobytes() + long(n) + value
        body += long(places[k + 1] if k + 1 < len(pages) else 0)
    body[4:8] = np.array([places[0]], order + "u4").tobytes()
    return bytes(body)


@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_of_both_byte_orders(spark, tmp_path, order):
    from framelake.sources import page_stacks

    pages = [np.arange(15).reshape(5, 3) * 4000 + k for k in range(5)]
    (tmp_path / "night.tif").write_bytes(hand_made(order, pages[:2]))
    (tmp_path / "night_X2.tif").write_bytes(hand_made(order, pages[2:4], 5))
    (tmp_path / "night_X10.tif").write_bytes(hand_made(order, pages[4:]))
    found = page_stacks.read_stack(spark, str(tmp_path))
    assert same(px(found), pages) and {(r.stream_id, r.pix_fmt) for r in found.collect()} == {("night", "Y_16")}
    past = raw_video.pages_at(raw_video.stack_pages(page_stacks.page_table(spark, str(tmp_path))), spark.createDataFrame([("night", 77)], "base string, position long")).collect()
    assert [(r.chunk, r.page) for r in past] == [(10, 0)]
    broken = bytearray(hand_made(order, pages[:1]))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.tif").write_bytes(b"XX" + broken[2:])
    with pytest.raises(Exception, match="not a stack"):
        page_stacks.read_stack(spark, str(tmp_path / "b")).count()


def test_written_pages_come_back(spark, tmp_path):
    from framelake.sources import page_stacks

    source = [a * 200 for a in ramp(10)]
    df = frames(spark, source, "Y_16", "a b").unionByName(frames(spark, source[:3], "Y_16", "c")).withColumn("frame_no", F.col("frame_no") * 3 + 5)
    page_stacks.write_stack(df, str(tmp_path / "s"), 4)
    assert sorted(os.listdir(tmp_path / "s")) == ["a%20b.tif", "a%20b_X2.tif", "a%20b_X3.tif", "c.tif"]
    back = page_stacks.read_stack(spark, str(tmp_path / "s"))
    assert same(px(back.where("stream_id = 'a b'")), source) and same(px(back.where("stream_id = 'c'")), source[:3])


def test_chunks_stay_whole_where_joins_turn_into_broadcasts(spark, tmp_path):
    """Joins by the chunk that become broadcasts at run time leave its rows to several tasks of the shuffle before."""
    from framelake.sources import page_stacks

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    before = {key: spark.conf.get(key, None) for key in conf}
    source = [a * 200 for a in ramp(100)]
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        page_stacks.write_stack(frames(spark, source, "Y_16"), str(tmp_path / "s"), 7)
        assert sorted(os.listdir(tmp_path / "s")) == sorted(["s.tif", *[f"s_X{k}.tif" for k in range(2, 16)]])
        assert same(px(page_stacks.read_stack(spark, str(tmp_path / "s"))), source)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
