"""Point operators: each pixel by itself, built-in functions only, no shuffle. A disabled pass returns its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import FORMATS, KEY, PEAK, channels, floats, peak, with_px
from ..functions.let import let


def each(fn: Callable[[Column], Column]) -> Column:
    return F.transform("px", lambda v: fn(v.cast("double")))


def per_pixel(fn: Callable[[Callable[[int], Column]], list[Column]], n: Column) -> Column:
    """fn(component -> value) for every pixel of n components; its columns become the components of the new pixel."""

    def made(px: Column, n: Column, count: Column) -> Column:
        index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(index, lambda i: F.array(*fn(lambda c: F.get(px, (i * n + c).cast("int")).cast("double")))))

    return let(made, "px", n, F.floor(F.size("px") / n).cast("int"))


def clamp(v: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))


def _as_unit(v: Column, kind: str) -> Column:
    return {"u8": (v + 0.5) / 256, "u16": (v + 0.5) / 65536, "f32": v}[kind]


def convert_format(df: DataFrame, to: str, enabled: bool = True) -> DataFrame:
    """Every format to every other: whole mean for grey, (v + 0.5) / 256 to float, truncation back, alpha 255."""
    if not enabled:
        return df
    goal = FORMATS[to]
    order = {"BGR": (2, 1, 0), "BGRA": (2, 1, 0), "RGBA": (0, 1, 2)}
    out = F.col("px")
    for name, have in FORMATS.items():
        if name == to:
            continue

        def rgb(at, name=name, have=have):
            return [at(0)] * 3 if have.channels == 1 else [at(c) for c in order.get(name, (0, 1, 2))]

        def moved(v, have=have):
            if have.kind == goal.kind:
                return v
            if goal.kind == "f32":
                return _as_unit(v, have.kind)
            if have.kind == "f32":
                return clamp(F.floor(v * (PEAK[goal.kind] + 1)), PEAK[goal.kind])
            return v * 256 if goal.kind == "u16" else F.floor(v / 256)

        def pixel(at, have=have, rgb=rgb, moved=moved):
            r, g, b = rgb(at)
            if goal.channels == 1:
                if have.channels == 1:
                    return [moved(r)]
                if goal.kind == "u16":
                    return [F.floor((r + g + b) * 256 / 3) if have.kind == "u8" else clamp(F.floor((r + g + b) / 3 * 65536), 65535)]
                return [moved(F.floor((r + g + b) / 3) if have.kind == "u8" else (r + g + b) / 3)]
            three = [moved(x) for x in (r, g, b)]
            three = [three[c] for c in order.get(to, (0, 1, 2))]
            return three + [F.lit(255.0)] * (goal.channels - 3)

        out = F.when(F.col("pix_fmt") == name, floats(per_pixel(pixel, F.lit(have.channels)))).otherwise(out)
    return with_px(df, out, to)


def to_y_f32(df: DataFrame, enabled: bool = True) -> DataFrame:
    """v / 256, (R + G + B) / 768, or v * 0.000015259 from 16 bits."""
    if not enabled:
        return df
    grey = F.when(F.col("pix_fmt") == "Y_8", each(lambda v: v / 256)).when(F.col("pix_fmt") == "Y_16", each(lambda v: v * 0.000015259))
    three = per_pixel(lambda at: [(at(0) + at(1) + at(2)) / F.when(F.col("pix_fmt") == "RGB_F32", 3.0).otherwise(768.0)], channels())
    return with_px(df, grey.when(channels() >= 3, three).otherwise(F.col("px").cast("array<double>")), "Y_F32")


def to_rgb_f32(df: DataFrame, enabled: bool = True) -> DataFrame:
    if not enabled:
        return df
    one = per_pixel(lambda at: [at(0) / 256] * 3, F.lit(1))
    flat = per_pixel(lambda at: [at(0)] * 3, F.lit(1))
    bgra = per_pixel(lambda at: [at(2) / 256, at(1) / 256, at(0) / 256], channels())
    fmt = F.col("pix_fmt")
    return with_px(df, F.when(fmt == "Y_8", one).when(fmt == "Y_F32", flat).when(fmt == "RGB_8", each(lambda v: v / 256)).when(fmt.isin("BGRA", "BGR"), bgra).otherwise(F.col("px").cast("array<double>")), "RGB_F32")


def _byte(v: Column, scale: float) -> Column:
    w = v * 256 * scale
    return F.when(w >= 255, 255.0).when(w <= 0, 0.0).otherwise(F.floor(w + 0.5).cast("double"))


def to_y8(df: DataFrame, scale: float = 1.0, enabled: bool = True) -> DataFrame:
    """Float grey to bytes: v * 256 * scale, rounded half up and clamped."""
    return with_px(df, each(lambda v: _byte(v, scale)), "Y_8") if enabled else df


def to_rgb8(df: DataFrame, scale: float = 1.0, enabled: bool = True) -> DataFrame:
    """From floats as to_y8; Y_8 is replicated and Y_16 gives its high byte."""
    if not enabled:
        return df
    fmt = F.col("pix_fmt")
    grey = lambda fn: per_pixel(lambda at: [fn(at(0))] * 3, F.lit(1))
    px = F.when(fmt == "RGB_F32", each(lambda v: _byte(v, scale))).when(fmt == "Y_F32", grey(lambda v: _byte(v, scale)))
    px = px.when(fmt == "Y_8", grey(lambda v: v)).when(fmt == "Y_16", grey(lambda v: F.floor(v / 256).cast("double")))
    return with_px(df, px.otherwise(F.col("px").cast("array<double>")), "RGB_8")


def tonemap(df: DataFrame, power: float, enabled: bool = True) -> DataFrame:
    """v ** p for floats, trunc((v / 255) ** p * 255 + 0.5) for bytes."""
    if not enabled:
        return df
    return with_px(df, F.when(peak() == 1.0, each(lambda v: F.pow(v, F.lit(power)))).otherwise(each(lambda v: F.floor(F.pow(v / 255, F.lit(power)) * 255 + 0.5).cast("double"))))


def gamma(df: DataFrame, g: float, enabled: bool = True) -> DataFrame:
    """Normalised value to the power g, in the format's range."""
    return with_px(df, let(lambda top: each(lambda v: F.pow(v / top, F.lit(g)) * top), peak())) if enabled else df


def sigmoid(df: DataFrame, centre: float = 0.5, slope: float = 5.0, enabled: bool = True) -> DataFrame:
    return with_px(df, each(lambda v: 1 / (1 + F.exp(-(v - centre) * slope)))) if enabled else df


def threshold_gt(df: DataFrame, t: float, enabled: bool = True) -> DataFrame:
    """The first component above t: 1 in all components, else 0."""
    if not enabled:
        return df
    return with_px(df, let(lambda px, n: F.transform(px, lambda _, i: F.when(F.get(px, (i - i % n).cast("int")) > t, 1.0).otherwise(0.0)), "px", channels()))


def threshold_ge(df: DataFrame, t: float, most: float = 255.0, enabled: bool = True) -> DataFrame:
    return with_px(df, each(lambda v: F.when(v >= t, float(most)).otherwise(0.0))) if enabled else df


def luma(df: DataFrame, enabled: bool = True) -> DataFrame:
    """0.2125 R + 0.7154 G + 0.0721 B, one component."""
    if not enabled:
        return df
    return with_px(df, per_pixel(lambda at: [at(0) * 0.2125 + at(1) * 0.7154 + at(2) * 0.0721], channels()), "Y_F32")


def palette_remap(df: DataFrame, lut: str | list[int], enabled: bool = True) -> DataFrame:
    """v -> lut[v]; lut: a column with 256 values (it stays), or the values."""
    if not enabled:
        return df
    table = F.col(lut) if isinstance(lut, str) else F.array(*[F.lit(x) for x in lut])
    return with_px(df, let(lambda px, values: F.transform(px, lambda v: F.get(values, v.cast("int"))), "px", table))


def identity_lut() -> Column:
    return F.sequence(F.lit(0), F.lit(255))


def add_noise(df: DataFrame, level: float, seed: int = 0, enabled: bool = True) -> DataFrame:
    """v + level * 255 * u + 0.5, truncated and clamped; u in [0, 1) from a hash of key, place and seed, so reruns agree."""
    if not enabled:
        return df
    u = lambda i: F.pmod(F.xxhash64(*KEY, i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    return with_px(df, F.transform("px", lambda v, i: F.least(F.lit(255.0), F.floor(v.cast("double") + level * 255 * u(i) + 0.5).cast("double"))))


def channel(df: DataFrame, c: int) -> DataFrame:
    """One component as a frame of its own."""
    grey = F.when(peak() == 1.0, "Y_F32").when(peak() == 255.0, "Y_8").otherwise("Y_16")
    return with_px(df, let(lambda n: F.filter("px", lambda _, i: i % n == c), channels())).withColumn("pix_fmt", grey)


def frames(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames start to stop - 1, every step-th by number: plain filters, which Parquet can use."""
    if start is not None:
        df = df.where(F.col("frame_no") >= start)
    if stop is not None:
        df = df.where(F.col("frame_no") < stop)
    return df.where(F.col("frame_no") % step == 0) if step > 1 else df


def with_metadata(df: DataFrame, meta: Column) -> DataFrame:
    """Metadata made from the row; pass a struct column."""
    return df.withColumn("meta", meta)


def prepare_input(df: DataFrame, w: int, h: int, mean: tuple[float, float, float] = (104, 117, 123)) -> DataFrame:
    """Model input: nearest resize to w x h, three components, channel means subtracted, planes one after another."""
    from .geometry import resize_nearest

    colour = resize_nearest(convert_format(df, "BGR"), w, h)

    def plane(px: Column, c: int) -> Column:
        return F.transform(F.filter(px, lambda _, i: i % 3 == c), lambda v: v - float(mean[c]))

    return with_px(colour, let(lambda px: F.concat(*[plane(px, c) for c in range(3)]), "px"), "RGB_F32")


def with_planes(df: DataFrame) -> DataFrame:
    """Planes one after another put back to interleaved pixels."""
    put = lambda px, n, size: F.transform(px, lambda _, i: F.get(px, ((i % n) * size + F.floor(i / n)).cast("int")))
    return with_px(df, let(put, "px", channels(), F.size("px") / channels()))
