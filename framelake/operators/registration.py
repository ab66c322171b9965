"""Camera motion: registration of consecutive frames, accumulated shifts, stabilised and dewarped frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import FORMATS, KEY
from ..functions import motion
from .geometry import remap
from .temporal import Block, affine_scan, block_scan, own_frames, with_previous
from .vector import px_lists, small_batches, utc


def _grey(px: pa.Scalar, h: int, w: int, n: int) -> np.ndarray:
    """The component that motion is measured on: green of colour frames."""
    frame = np.asarray(px.values.to_numpy(zero_copy_only=False), float).reshape(h, w, n)
    return frame[:, :, 1 if n >= 3 else 0]


def _pairs(batch: pa.RecordBatch):
    for px, prev, w, h, fmt in zip(*(batch.column(c) for c in ("px", "prev", "width", "height", "pix_fmt"))):
        shape = h.as_py(), w.as_py(), FORMATS[fmt.as_py()].channels
        yield _grey(px, *shape), _grey(prev, *shape) if prev.is_valid else None


def register_pairs(df: DataFrame) -> DataFrame:
    """HVECT (key, hx, hy): frame(x) = frame before(x + h); 0 for the first. Pairs are independent tasks' work."""
    small_batches(df)
    paired = with_previous(df)

    def run(batches):
        for batch in batches:
            found = [motion.register(a, b) if b is not None else (0.0, 0.0) for a, b in _pairs(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], names=[*KEY, "hx", "hy"])

    return paired.mapInArrow(run, paired.select(*KEY).schema.add("hx", "double").add("hy", "double"))


def register_rois(df: DataFrame, rois: list[tuple[int, int, int, int]]) -> DataFrame:
    """(key, hx, hy): the mean over regions (x, y, w, h) of their pooled registrations."""
    small_batches(df)
    paired = with_previous(df)

    def run(batches):
        for batch in batches:
            found = []
            for a, b in _pairs(batch):
                each = [motion.register(a[y : y + h, x : x + w], b[y : y + h, x : x + w], pooled=True) for x, y, w, h in rois] if b is not None else [(0.0, 0.0)]
                found.append(np.mean(each, axis=0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *(pa.array([float(f[i]) for f in found], pa.float64()) for i in (0, 1))], names=[*KEY, "hx", "hy"])

    return paired.mapInArrow(run, paired.select(*KEY).schema.add("hx", "double").add("hy", "double"))


def accumulate_shift(hvect: DataFrame, bx: float = 1.0, by: float = 1.0) -> DataFrame:
    """hvect with cum_hx, cum_hy: c = (c + h) * burn from the fourth frame on, 0 before."""
    late = F.col("frame_no") > 2
    b = F.array(*[F.when(late, F.col(c) * burn).otherwise(0.0) for c, burn in (("hx", bx), ("hy", by))])
    rows = hvect.withColumn("px", F.lit(None).cast("array<float>"))
    scanned = affine_scan(rows, F.array(F.lit(bx), F.lit(by)), b, "__c", size=4096)
    return scanned.select(*hvect.columns, F.col("__c")[0].alias("cum_hx"), F.col("__c")[1].alias("cum_hy"))


def stabilise(df: DataFrame, hvect: DataFrame, mode: str = "integer", border: float = 0.0) -> DataFrame:
    """Each frame moved by its accumulated shift: `integer` (nearest), `subpixel` (bilinear) or `none`."""
    if mode == "none":
        return df
    rows = df.join(hvect.select(*KEY, "cum_hx", "cum_hy"), KEY)
    if mode == "integer":
        near = lambda c: F.floor(F.col(c) + 0.5)
        return remap(rows, F.col("width"), F.col("height"), lambda x, y: (x - near("cum_hx"), y - near("cum_hy")), border).select(*df.columns)
    small_batches(df)
    names = df.columns

    def run(batches):
        for batch in batches:
            out = []
            for px, w, h, fmt, cx, cy in zip(*(batch.column(c) for c in ("px", "width", "height", "pix_fmt", "cum_hx", "cum_hy"))):
                frame = np.asarray(px.values.to_numpy(zero_copy_only=False), float).reshape(h.as_py(), w.as_py(), FORMATS[fmt.as_py()].channels)
                still = np.zeros(frame.shape[:2])
                out.append(motion.warp(frame, still - cx.as_py(), still - cy.as_py(), border))
            yield pa.RecordBatch.from_arrays([px_lists(out) if c == "px" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, df.schema)


def dewarp(df: DataFrame, longevity: float = 0.95, border: float = 0.0) -> DataFrame:
    """Frames drawn towards a running mean of the frames before: the reference is a scan over blocks, the flow per frame."""
    names = df.columns

    def step(block: Block, some: slice, held, done: list):
        keep = np.where(block.no < 3, 0.0, longevity)[:, None]
        return keep, block.prev(some) * (1 - keep)

    def finish(block: Block, chunks) -> pa.Table:
        ref = np.empty((len(block.rows), block.all.shape[1]))
        for some, done in chunks:
            ref[:, some] = done[0]
        out = [drawn(block.all[i].astype(float).reshape(block.shape), goal.reshape(block.shape), border) for i, goal in zip(block.rows, ref)]
        return utc(own_frames(block, out).select(names))

    return block_scan(df, [step], finish, df.schema, before=1)


def drawn(frame: np.ndarray, goal: np.ndarray, border: float) -> np.ndarray:
    """frame warped by its flow towards goal."""
    return motion.warp(frame, *motion.dense_flow(frame.mean(-1), goal.mean(-1)), border)


def to_reference(df: DataFrame, border: float = 0.0) -> DataFrame:
    """Each frame warped by its flow towards its column ref; no state, so it works on streams too."""
    small_batches(df)
    names = df.columns

    def run(batches):
        for batch in batches:
            out = []
            for px, ref, w, h, fmt in zip(*(batch.column(c) for c in ("px", "ref", "width", "height", "pix_fmt"))):
                shape = h.as_py(), w.as_py(), FORMATS[fmt.as_py()].channels
                frame, goal = (np.asarray(a.values.to_numpy(zero_copy_only=False), float).reshape(shape) for a in (px, ref))
                out.append(drawn(frame, goal, border))
            yield pa.RecordBatch.from_arrays([px_lists(out) if c == "px" else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, df.schema)


