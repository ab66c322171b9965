"""The three main workloads as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import filters, histograms, points, registration, temporal


def motion_detection(df: DataFrame, target: float = 0.6, window: int = 128, thr: float = 3.5, run: int = 2, cell: int = 16) -> tuple[DataFrame, DataFrame]:
    """(frames with detected cells brightened, cells): float, local equalisation, stabilisation, background, cells."""
    ready = filters.equalise_local(points.to_y_f32(df), target, window)
    shifts = registration.accumulate_shift(registration.register_pairs(ready), 0.95, 0.95)
    still = points.to_y8(registration.stabilise(ready, shifts), 0.99)
    cells = temporal.persistent(temporal.motion(still, thr=thr, cell=cell), run)
    return temporal.motion_overlay(still, cells, cell), cells


def enhancement(df: DataFrame, longevity: float = 0.95) -> DataFrame:
    """Colour float frames stabilised, dewarped, averaged over four and sharpened."""
    ready = points.to_rgb_f32(df)
    still = registration.stabilise(ready, registration.accumulate_shift(registration.register_pairs(ready)))
    return filters.unsharp(temporal.average(registration.dewarp(still, longevity), 2), 20.0, 2.0)


def equalisation(df: DataFrame, pixel_stride: int = 3, image_stride: int = 5) -> DataFrame:
    """Histogram equalisation with the table of every image_stride-th frame."""
    return histograms.hist_equalise(df, pixel_stride, image_stride)
