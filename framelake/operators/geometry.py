"""Geometry: every output pixel names its source pixel, so an operator is an index map over the array; no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import channels, with_px
from ..functions import stack
from ..functions.let import let
from .vector import per_stack, switchable

Place = tuple[Column, Column]


def remap(df: DataFrame, width: Column, height: Column, source: Callable[[Column, Column], Place], border: float | None = 0.0) -> DataFrame:
    """A frame of width x height whose pixel (x, y) is the input's source(x, y); outside: border (None: null)."""

    def made(px: Column, n: Column, new_w: Column, total: Column) -> Column:
        def value(i: Column) -> Column:
            x, y = source(F.floor(i / n) % new_w, F.floor(i / (n * new_w)))
            inside = (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))
            return F.when(inside, F.get(px, ((y * F.col("width") + x) * n + i % n).cast("int"))).otherwise(F.lit(border).cast("float"))

        index = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(index, value)

    return with_px(df, let(made, "px", channels(), width, (width * height * channels()).cast("int")), width=width, height=height)


@switchable
def crop(df: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The rows' slices, one after another."""
    rows = lambda px, n: F.transform(F.sequence(F.lit(y0), F.lit(y0 + h - 1)), lambda y: F.slice(px, ((y * F.col("width") + x0) * n + 1).cast("int"), (w * n).cast("int")))
    return with_px(df, F.flatten(let(rows, "px", channels())), width=F.lit(w), height=F.lit(h))


@switchable
def flip(df: DataFrame, lr: bool = False, tb: bool = False) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return remap(df, w, h, lambda x, y: (w - 1 - x if lr else x, h - 1 - y if tb else y))


@switchable
def rotate90(df: DataFrame, k: int = 1) -> DataFrame:
    """k quarter turns; (x, y) goes to (H - 1 - y, x) in the first."""
    w, h, k = F.col("width"), F.col("height"), k % 4
    if k == 0:
        return df
    if k == 2:
        return flip(df, True, True)
    return remap(df, h, w, lambda x, y: (y, h - 1 - x) if k == 1 else (w - 1 - y, x))


@switchable
def transform2d(df: DataFrame, a: float, b: float, c: float, d: float, border: float | None = 0.0) -> DataFrame:
    """A 2 x 2 matrix about the centre, nearest sample (truncated after adding a half)."""
    w, h = F.col("width"), F.col("height")
    near = lambda v: F.when(v + 0.5 >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v + 0.5))

    def source(x: Column, y: Column) -> Place:
        cx, cy = x - w / 2.0, y - h / 2.0
        return near(cx * a + cy * b + w / 2.0), near(cx * c + cy * d + h / 2.0)

    return remap(df, w, h, source, border)


@switchable
def translate(df: DataFrame, tx: float, ty: float, border: float = 0.0) -> DataFrame:
    """out(x, y) = in(x - tx, y - ty); whole shifts re-index, fractional ones are bilinear."""
    if float(tx).is_integer() and float(ty).is_integer():
        return remap(df, F.col("width"), F.col("height"), lambda x, y: (x - int(tx), y - int(ty)), border)
    import numpy as np

    def shift(s):
        y, x = np.mgrid[: s.shape[1], : s.shape[2]]
        return np.stack([stack.bilinear(f, x - tx, y - ty, border) for f in s])

    return per_stack(df, shift)


@switchable
def affine(df: DataFrame, m: list[list[float]], border: float = 0.0) -> DataFrame:
    """The frame drawn where the matrix puts its corners (no translation, no perspective divide), nearest sample."""
    (a, b), (c, d) = m[0][:2], m[1][:2]
    det = a * d - b * c
    if not det:
        raise ValueError("the matrix has no inverse")
    w, h = F.col("width"), F.col("height")
    return remap(df, w, h, lambda x, y: (F.floor((x * d - y * b) / det + 0.5), F.floor((y * a - x * c) / det + 0.5)), border)


@switchable
def resize_nearest(df: DataFrame, w: int, h: int) -> DataFrame:
    """Source column trunc(x * width / w), source row trunc(y / h * height)."""
    return remap(df, F.lit(w), F.lit(h), lambda x, y: (F.floor(x * F.col("width") / w), F.floor(y * F.col("height") / h)))


@switchable
def downsample_box(df: DataFrame, f: int) -> DataFrame:
    """Mean of f x f blocks; a rest at the right and lower edge is dropped."""
    return per_stack(df, lambda s: stack.downsample_box(s, f))


@switchable
def downsample_gauss(df: DataFrame, radius: float, k: int) -> DataFrame:
    return per_stack(df, lambda s: stack.downsample_gauss(s, radius, k))
