"""Operators on several streams, aligned by position: equi-joins on frame number, unions with an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import floats, with_px
from .geometry import remap, resize_nearest
from .points import convert_format
from .ranges import BOX, covered, touching

AT = ["frame_no", "img_no"]


def _paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a with the other stream's pixels; a row whose formats or sizes differ fails the query."""
    return of_one_format(a.join(b.select(*on, F.col("px").alias("px_b"), F.struct("pix_fmt", "width", "height").alias("shape_b")), on))


def of_one_format(both: DataFrame) -> DataFrame:
    """both without shape_b, which has to be the row's own format and size."""
    same = F.struct("pix_fmt", "width", "height") == F.col("shape_b")
    return both.withColumn("px_b", F.when(same, F.col("px_b")).otherwise(F.raise_error("the streams' formats differ"))).drop("shape_b")


def difference(both: DataFrame, scale: float) -> DataFrame:
    """|(px - px_b) * scale| of joined rows."""
    return with_px(both, F.zip_with("px", "px_b", lambda x, y: F.abs((x.cast("double") - y) * scale)))


def gained(both: DataFrame, gain: float) -> DataFrame:
    """(px - px_b) * gain + px_b of joined rows."""
    return with_px(both, F.zip_with("px", "px_b", lambda x, m: (x.cast("double") - m) * gain + m))


def diff_and_scale(a: DataFrame, b: DataFrame, scale: float, on: list[str] = AT) -> DataFrame:
    """|(a - b) * scale|, slot by slot."""
    return difference(_paired(a, b, on), scale).select(*a.columns)


def masked_gain(a: DataFrame, mask: DataFrame, gain: float, on: list[str] = AT) -> DataFrame:
    """(a - mask) * gain + mask."""
    return gained(_paired(a, mask, on), gain).select(*a.columns)


def fuse(df: DataFrame, setup: DataFrame) -> DataFrame:
    """One colour frame per slot: each image moved, turned and scaled as its setup row says, times its RGB weights, summed.

    setup(img_no, x, y, scale, angle, r, g, b): a row per camera of a slot; Spark broadcasts it if its size is small.
    """
    rows = df.join(setup.withColumnsRenamed({"x": "s_x", "y": "s_y", "scale": "s_scale", "angle": "s_angle", "r": "s_r", "g": "s_g", "b": "s_b"}), "img_no")
    w, h = F.col("width"), F.col("height")
    turn = F.radians("s_angle")

    def source(x: Column, y: Column) -> tuple[Column, Column]:
        u, v = (x - w / 2.0 - F.col("s_x")) / F.col("s_scale"), (y - h / 2.0 - F.col("s_y")) / F.col("s_scale")
        return F.floor(u * F.cos(turn) + v * F.sin(turn) + w / 2.0 + 0.5), F.floor(v * F.cos(turn) - u * F.sin(turn) + h / 2.0 + 0.5)

    moved = remap(rows, w, h, source)
    three = F.flatten(F.transform("px", lambda v: F.array(*[v.cast("double") * F.col(c) for c in ("s_r", "s_g", "s_b")])))
    by = ["stream_id", "frame_no"]
    # the images of a slot are few; their arrays meet once and are added
    slots = moved.withColumn("part", three).groupBy(*by).agg(F.min_by(F.struct(*[c for c in df.columns if c not in by]), "img_no").alias("one"), F.collect_list(F.struct("img_no", "part")).alias("parts"))
    total = F.aggregate(F.array_sort("parts"), F.transform(F.col("parts")[0]["part"], lambda v: F.lit(0.0)), lambda acc, p: F.zip_with(acc, p["part"], lambda a, b: a + b))
    kept = [F.col("one")[c].alias(c) for c in df.columns if c not in (*by, "px", "pix_fmt", "img_no")]
    return slots.select(*by, *kept, floats(total).alias("px"), F.lit("RGB_F32").alias("pix_fmt"), F.lit(0).alias("img_no")).select(*df.columns)


def multiplex(sources: list[DataFrame], w: int, h: int, fmt: str, source: int = -1) -> DataFrame:
    """Frames of n streams in turn, resized and converted; frame k of source s gets the number k * n + s.

    The merge ends where the shortest stream ends (one number each, found by aggregation). source >= 0: that one only.
    """
    ready = [convert_format(resize_nearest(df, w, h), fmt).withColumn("source_no", F.lit(i)) for i, df in enumerate(sources)]
    if source >= 0:
        return ready[source]
    union = ready[0]
    for df in ready[1:]:
        union = union.unionByName(df)
    return in_turn(union, len(sources))


def in_turn(union: DataFrame, n: int | None = None) -> DataFrame:
    """Frames of sources 0 to n - 1 (source_no) numbered in turn, up to the end of the shortest; no n: the sources there are."""
    ends = union.groupBy("source_no").agg(F.max("frame_no").alias("last")).agg(F.min("last").alias("last"), F.count("*").alias("n"))
    all_there = F.lit(True) if n is None else F.col("n") == n
    cut = union.crossJoin(F.broadcast(ends)).where((F.col("frame_no") <= F.col("last")) & all_there)  # one row
    return cut.withColumn("frame_no", F.col("frame_no") * F.col("n") + F.col("source_no")).drop("last", "n")


def slots(df: DataFrame, images: int) -> DataFrame:
    """(stream_id, frame_no, images): frames of one number in one row, ordered by img_no; incomplete slots go."""
    whole = F.struct("img_no", *[c for c in df.columns if c not in ("stream_id", "frame_no", "img_no")])
    return df.groupBy("stream_id", "frame_no").agg(F.sort_array(F.collect_list(whole)).alias("images")).where(F.size("images") == images)


def attach_metadata(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Record i of meta(stream_id, frame_no, meta) with frame i; frames without one get null."""
    return df.drop("meta").join(meta.select("stream_id", "frame_no", "meta"), ["stream_id", "frame_no"], "left")


def label(dets: DataFrame, labels: DataFrame) -> DataFrame:
    """class_id to class name; labels(class_id, name) is the labels file; Spark broadcasts it if its size is small."""
    return dets.join(labels, "class_id", "left")


def in_roi(rects: DataFrame, roi: DataFrame) -> DataFrame:
    """Rectangles that touch one of roi(l, r, t, b); either side may have any number of rows."""
    return rects.join(touching(rects, roi), BOX, "left_semi")


def record_between(df: DataFrame, intervals: DataFrame, at: str = "frame_no") -> DataFrame:
    """Frames inside a recording: intervals(start_no, stop_no), stop exclusive, any number of them; `at` may be a time."""
    return df.join(covered(df, intervals, at, "start_no", "stop_no"), at, "left_semi")


def latest_frame(df: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """The newest frame of each image stream, and how many there were.

    Frames that come while the buffer is held, in holds(start_no, stop_no), stop exclusive, change neither.
    """
    if holds is not None:
        df = df.join(covered(df, holds, "frame_no", "start_no", "stop_no"), "frame_no", "left_anti")
    rest = [c for c in df.columns if c not in ("stream_id", "img_no")]
    return df.groupBy("stream_id", "img_no").agg(F.max_by(F.struct(*rest), "frame_no").alias("f"), F.count("*").alias("seq")).select("stream_id", "img_no", *[F.col(f"f.{c}").alias(c) for c in rest], "seq")
