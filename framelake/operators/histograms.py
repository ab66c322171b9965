"""Histograms, look-up tables and per-frame statistics: a frame's histogram and table are made inside its row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from ..frames import KEY, channels, peak, with_px
from ..functions import stack
from ..functions.let import let
from .points import clamp, convert_format, each, palette_remap
from .temporal import affine_scan
from .vector import per_stack, px_lists, shapes, small_batches, stacked

BINS = 256


def frame_counts(df: DataFrame, pixel_stride: int = 1, image_stride: int = 1) -> DataFrame:
    """(key, counts): the histogram of each picked frame as an array of 256 counts or more, made inside its row."""
    small_batches(df)
    picked = df.where(F.col("frame_no") % image_stride == 0).select(*KEY, "width", "height", "pix_fmt", "px")

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for shape, rows in shapes(batch).items():
                first = stacked(batch.column("px"), rows, shape)[..., 0].reshape(len(rows), -1)[:, ::pixel_stride]
                for i, n in zip(rows, stack.counts(first)):
                    out[i] = n * pixel_stride
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(out, pa.list_(pa.int64()))], names=[*KEY, "counts"])

    schema = picked.select(*KEY).schema.add("counts", ArrayType(LongType()))
    return picked.mapInArrow(run, schema)


def histogram(df: DataFrame, pixel_stride: int = 1, image_stride: int = 1) -> DataFrame:
    """(key, bin, n) of the first component; every pixel_stride-th pixel counts pixel_stride, every image_stride-th frame."""
    return frame_counts(df, pixel_stride, image_stride).select(*KEY, F.posexplode("counts").alias("bin", "n")).where("n > 0")


def ref_hist(n: Column | int) -> Column:
    """Array of the uniform histogram of n values: each bin rounds what is missing to the running target."""
    n = n if isinstance(n, Column) else F.lit(n)
    goal = lambda i: ((i + 1) / 256.0) * n
    # rounding half up what is missing keeps the running total at floor(target + 0.5)
    total = lambda i: F.floor(goal(i) + 0.5)
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: (total(i) - F.when(i > 0, total(i - 1)).otherwise(0)).cast("long"))


def dense(hist: DataFrame) -> DataFrame:
    """(key, counts) from (key, bin, n): one exchange of at most 256 rows a frame; a table that has counts passes."""
    if "counts" in hist.columns:
        return hist
    n = F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int").alias("bin"), "n")))  # 256 of them
    return hist.groupBy(*KEY).agg(n.alias("n")).select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("n", i), F.lit(0).cast("long"))).alias("counts"))


def _luts(counts: DataFrame, make, *more: str) -> DataFrame:
    """(key, lut) with make(counts of a frame, further array columns) for each row."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("counts", *more)))
            made = [make(*(np.array(x[:BINS], np.int64) for x in row)).astype(np.int32) for row in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(made, pa.list_(pa.int32()))], names=[*KEY, "lut"])

    return counts.mapInArrow(run, counts.select(*KEY).schema.add("lut", ArrayType(IntegerType())))


def match_map(hist: DataFrame, ref: Column | None = None) -> DataFrame:
    """(key, lut): a bin goes to the first reference bin whose inclusive total passes the bin's total before it, else 255.

    hist: histogram() or frame_counts(); ref: array of 256 counts, by default the uniform one of each frame's own total.
    """
    if ref is None:
        return _luts(dense(hist), stack.match_lut)
    return _luts(dense(hist).withColumn("ref", ref.cast("array<bigint>")), stack.match_lut, "ref")


def stretch_map(hist: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """(key, lut): 0 below the last bin whose share before it is under lo, linear to 255 at the last one under hi."""
    return _luts(dense(hist), lambda n: stack.stretch_lut(n, lo, hi))


def _remapped(df: DataFrame, make) -> DataFrame:
    """Frames through the table that make(counts) gives for each, inside their rows."""

    def remap(s: np.ndarray) -> np.ndarray:
        luts = np.stack([make(n[:BINS]) for n in stack.counts(s[..., 0].reshape(len(s), -1))])
        return luts[np.arange(len(s)), s.astype(np.int64).reshape(len(s), -1).T].T.reshape(s.shape)

    return per_stack(df, remap)


def with_lut(df: DataFrame, luts: DataFrame, every: int = 1) -> DataFrame:
    """Frames joined with the table of the frame at their number's last multiple of every, and remapped."""
    keyed = df.withColumn("lut_frame", F.col("frame_no") - F.col("frame_no") % every)
    tables = luts.select("stream_id", "img_no", F.col("frame_no").alias("lut_frame"), "lut")
    return palette_remap(keyed.join(tables, ["stream_id", "img_no", "lut_frame"]), "lut").select(*df.columns)


def hist_equalise(df: DataFrame, pixel_stride: int = 1, image_stride: int = 1) -> DataFrame:
    """Histogram, uniform reference, match map, remap: frames between two histograms use the earlier one.

    Without an image stride a frame needs its own table only, and nothing is shuffled.
    """
    if image_stride == 1 and pixel_stride == 1:
        return _remapped(df, stack.match_lut)
    return with_lut(df, match_map(frame_counts(df, pixel_stride, image_stride)), image_stride)


def cdf_equalise(df: DataFrame) -> DataFrame:
    """trunc(255 * cdf(v) / N)."""
    return _remapped(df, stack.cdf_lut)


def equalize_hist(df: DataFrame) -> DataFrame:
    """Grey first; (cdf(v) - cdf_min) / (N - cdf_min) * 255, rounded; a flat frame stays."""
    return _remapped(convert_format(df, "Y_8"), stack.spread_lut)


def frame_mean(df: DataFrame) -> Column:
    """Mean over all components, as a column."""
    return F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / F.size("px")


def with_mean(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", frame_mean(df))


def equalise(df: DataFrame, target: float) -> DataFrame:
    """v * target * (greatest value of the format) / mean, clamped to the format; a frame of mean 0 stays."""
    own = df.withColumn("_mean", frame_mean(df)).withColumn("_goal", F.lit(float(target)) * peak())
    scaled = let(lambda goal, mean: each(lambda v: v * goal / mean), "_goal", "_mean")
    held = F.when(peak() > 1, F.transform(scaled, lambda v: F.floor(clamp(v, 65535.0)))).otherwise(scaled)
    held = let(lambda x, top: F.transform(x, lambda v: F.least(v, top)), held, F.when(peak() > 1, peak()).otherwise(F.lit(float("inf"))))
    return with_px(own, F.when(F.col("_mean") == 0, F.col("px").cast("array<double>")).otherwise(held.cast("array<double>"))).drop("_mean", "_goal")


def equalise_drift(df: DataFrame, t0: float, speed: float) -> DataFrame:
    """The target follows the means, T = T * (1 - speed) + mean * speed, and v becomes min(255, trunc(v * T / mean + 0.5))."""
    first = F.col("frame_no") == 0
    rows = df.withColumn("_mean", frame_mean(df))
    start = F.when(first, F.lit(t0 * (1 - speed))).otherwise(0.0)
    scanned = affine_scan(rows, F.array(F.when(first, 0.0).otherwise(1 - speed)), F.array(start + F.col("_mean") * speed), "_t")
    return to_drifting_target(scanned)


def to_drifting_target(scanned: DataFrame) -> DataFrame:
    """Pixels brought from _mean to _t[0], rounded; both columns go. A frame of mean 0 stays."""
    moved = let(lambda t, mean: each(lambda v: F.least(F.lit(255.0), F.floor(v * t / mean + 0.5).cast("double"))), F.col("_t")[0], "_mean")
    return with_px(scanned, F.when(F.col("_mean") == 0, F.col("px").cast("array<double>")).otherwise(moved)).drop("_mean", "_t")


def equalise_local_drift(df: DataFrame, frac: float, speed: float, t0: float) -> DataFrame:
    """Local equalisation over a window of frac of the width, with the target of equalise_drift."""
    small_batches(df)
    first = F.col("frame_no") == 0
    rows = df.withColumn("_mean", frame_mean(df))
    start = F.when(first, F.lit(t0 * (1 - speed))).otherwise(0.0)
    scanned = affine_scan(rows, F.array(F.when(first, 0.0).otherwise(1 - speed)), F.array(start + F.col("_mean") * speed), "_t").withColumn("_t", F.col("_t")[0])
    names = df.columns

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            goal = np.asarray(batch.column("_t").to_numpy(zero_copy_only=False))
            for shape, rows in shapes(batch).items():
                made = stack.equalise_local(stacked(batch.column("px"), rows, shape), goal[rows][:, None, None, None], stack.odd(int(frac * shape[1])))
                for k, i in enumerate(rows):
                    out[i] = made[k]
            yield pa.RecordBatch.from_arrays([px_lists(out) if c == "px" else batch.column(c) for c in names], names=names)

    return scanned.mapInArrow(run, df.schema)


def auto_contrast(df: DataFrame) -> DataFrame:
    """trunc((v - min) / (max - min) * 255); a flat frame becomes 0."""
    spread = lambda px, low, high: F.transform(px, lambda v: F.when(high == low, 0.0).otherwise(F.floor((v.cast("double") - low) / (high - low) * 255).cast("double")))
    return with_px(df, let(spread, "px", F.array_min("px").cast("double"), F.array_max("px").cast("double")))


def stage_stats(timings: DataFrame) -> DataFrame:
    """timings(stage, idx, dur_ns): count, least, whole average, greatest and the first index that has it."""
    return timings.groupBy("stage").agg(
        F.count("*").alias("n"), F.min("dur_ns").alias("min_ns"), F.floor(F.sum("dur_ns") / F.count("*")).alias("avg_ns"), F.max("dur_ns").alias("max_ns"),
        F.max(F.struct("dur_ns", (-F.col("idx")).alias("minus"))).alias("m"),
    ).select("stage", "n", "min_ns", "avg_ns", "max_ns", (-F.col("m.minus")).alias("max_idx"))


def num_frames(df: DataFrame) -> DataFrame:
    """Frames of each stream: the most over the images of its slots."""
    return df.groupBy("stream_id", "img_no").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.max("n").alias("frames"))
