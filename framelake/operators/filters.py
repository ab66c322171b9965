"""Neighbourhood filters: a row is a frame (or a tile with its halo), so none of them shuffles.

border: 'zero' (default) or 'null' for pixels whose neighbourhood leaves the frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import with_px
from ..functions import stack
from .vector import per_stack, switchable

BORDER = {"zero": 0.0, "null": float("nan")}


@switchable
def integral(df: DataFrame) -> DataFrame:
    """Inclusive prefix sums over both axes."""
    return per_stack(df, stack.integral)


@switchable
def box(df: DataFrame, k: int, mode: str = "mean", border: str = "zero") -> DataFrame:
    return per_stack(df, lambda s: stack.box(s, k, mode, BORDER[border]))


def box_sigma(k: int) -> float:
    """Standard deviation of a box of k."""
    return stack.box_sigma(k)


@switchable
def gauss(df: DataFrame, radius: float, k: int, whole: bool = False, border: str = "zero") -> DataFrame:
    return per_stack(df, lambda s: stack.gauss(s, radius, k, whole, BORDER[border]))


@switchable
def gauss_approx(df: DataFrame, k: int, n: int) -> DataFrame:
    return per_stack(df, lambda s: stack.gauss_approx(s, k, n))


@switchable
def gradient_x(df: DataFrame) -> DataFrame:
    return per_stack(df, lambda s: stack.gradients(s)[0])


@switchable
def gradient_y(df: DataFrame) -> DataFrame:
    return per_stack(df, lambda s: stack.gradients(s)[1])


@switchable
def edge_detect(df: DataFrame, d: int = 1) -> DataFrame:
    return per_stack(df, lambda s: stack.edge_detect(s, d))


@switchable
def laplacian(df: DataFrame) -> DataFrame:
    return per_stack(df, stack.laplacian)


@switchable
def median_quadrant(df: DataFrame, f: int) -> DataFrame:
    return per_stack(df, lambda s: stack.median_quadrant(s, f))


@switchable
def erode(df: DataFrame, s: int) -> DataFrame:
    return per_stack(df, lambda x: stack.extreme(x, s, False))


@switchable
def dilate(df: DataFrame, s: int) -> DataFrame:
    return per_stack(df, lambda x: stack.extreme(x, s, True))


@switchable
def absdiff(df: DataFrame, other: str | Column) -> DataFrame:
    """|px - other| for a second array column of the same row (a joined or lagged frame)."""
    return with_px(df, F.zip_with("px", other, lambda a, b: F.abs(a - b)))


@switchable
def morph(df: DataFrame, passes: list[str], s: int = 3, t: float = 128.0, most: float = 255.0) -> DataFrame:
    """Any list of ERODE, DILATE, SOURCE_MINUS, MINUS_SOURCE, THRESHOLD; opening is ERODE, DILATE."""
    return per_stack(df, lambda x: stack.morphology(x, passes, s, t, most))


@switchable
def unsharp(df: DataFrame, gain: float, radius: float) -> DataFrame:
    return per_stack(df, lambda s: stack.unsharp(s, gain, radius))


@switchable
def adaptive_threshold(df: DataFrame, k: int, n: int, offset: float, whole: bool = True, most: float = 255.0, noise_k: int = 7) -> DataFrame:
    """The thresholded frame and `share`, the part of its values that are set."""

    def fn(s: np.ndarray):
        out = stack.adaptive_threshold(s, k, n, offset, whole, most, noise_k)
        return out, (out > 0).mean((1, 2, 3))

    return per_stack(df, fn, extra="share")


@switchable
def equalise_local(df: DataFrame, target: float, w: int) -> DataFrame:
    return per_stack(df, lambda s: stack.equalise_local(s, target, w))


@switchable
def retinex(df: DataFrame, g: int = 20, scales: int = 3, blur: str = "gauss") -> DataFrame:
    return per_stack(df, lambda s: stack.retinex(s, g, scales, blur))


@switchable
def clahe(df: DataFrame, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    return per_stack(df, lambda s: stack.clahe(s, clip, tiles))


@switchable
def pulse_filter(df: DataFrame, p: int) -> DataFrame:
    return per_stack(df, lambda s: np.stack([np.stack([stack.pulse_filter(f[:, :, c], p) for c in range(f.shape[2])], -1) for f in s]))
