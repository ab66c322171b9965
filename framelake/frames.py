"""The tables of the library: one row per image, its pixels in one flat row-major interleaved array.

FRAMES  stream_id STRING, frame_no BIGINT, img_no INT, ts TIMESTAMP, width INT, height INT, pix_fmt STRING,
        px ARRAY<FLOAT>, meta STRUCT<ts_ns BIGINT>
PIXELS  stream_id, frame_no, img_no, x INT, y INT, c INT, v FLOAT: a view for tests and cell-level work, not for storage
Order is frame_no within (stream_id, img_no), and those three are a key. Metadata passes through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.let import let

SCHEMA = "stream_id string, frame_no bigint, img_no int, ts timestamp, width int, height int, pix_fmt string, px array<float>, meta struct<ts_ns: bigint>"
KEY = ["stream_id", "frame_no", "img_no"]
IMAGE = ["stream_id", "img_no"]


class Format(NamedTuple):
    id: int
    channels: int
    bytes_per_channel: int
    kind: str


# Pixel formats with their ids in the raw container.
FORMATS = {
    "Y_8": Format(1, 1, 1, "u8"), "RGB_8": Format(2, 3, 1, "u8"), "Y_16": Format(3, 1, 2, "u16"), "BGR": Format(5, 3, 1, "u8"),
    "BGRA": Format(6, 4, 1, "u8"), "Y_F32": Format(7, 1, 4, "f32"), "RGB_F32": Format(8, 3, 4, "f32"), "RGBA": Format(9, 4, 1, "u8"),
}
#: The greatest value of a component; 1 for floats.
PEAK = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}


def _by_format(value) -> Column:
    out = F.when(F.lit(False), F.lit(value(FORMATS["Y_8"])))
    for wanted in dict.fromkeys(map(value, FORMATS.values())):
        out = out.when(F.col("pix_fmt").isin([name for name, f in FORMATS.items() if value(f) == wanted]), F.lit(wanted))
    return out


def channels() -> Column:
    """Components per pixel of each row's format."""
    return _by_format(lambda f: f.channels)


def peak() -> Column:
    """The greatest value of a component of each row's format."""
    return _by_format(lambda f: PEAK[f.kind])


def floats(px: Column) -> Column:
    return px.cast("array<float>")


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 Y_8 frame per vector, a stream per label, in order of vec_id."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    grey = F.transform("embedding", lambda e: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), e.cast("double") * 256 + 128))))
    return table.select(
        F.col("label").cast("string").alias("stream_id"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame_no"),
        F.lit(0).alias("img_no"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.lit("Y_8").alias("pix_fmt"),
        floats(grey).alias("px"),
        F.struct((F.col("vec_id") * 50_000_000).alias("ts_ns")).alias("meta"),
    )


def tiled(df: DataFrame, side: int = 4) -> DataFrame:
    """Test frames large enough to be registered: side * side consecutive one-channel frames of a stream, row by row, in one.

    Places after the last frame of a stream are grey. With 4, the 8 x 8 frames become 32 x 32, and tables of 50 vectors a
    stream still have several frames.
    """
    each = side * side
    rest = [c for c in df.columns if c not in (*KEY, "px")]
    groups = df.groupBy("stream_id", "img_no", F.floor(F.col("frame_no") / each).alias("frame_no")).agg(
        F.sort_array(F.collect_list(F.struct("frame_no", "px"))).alias("tiles"), F.min_by(F.struct(*rest), "frame_no").alias("one")
    )

    def place(px: Column, w: Column, h: Column) -> Column:
        def value(i: Column) -> Column:
            y, x = F.floor(i / (w * side)), i % (w * side)
            tile = F.floor(y / h) * side + F.floor(x / w)
            return F.coalesce(F.get(px, (tile * w * h + (y % h) * w + x % w).cast("int")), F.lit(128.0))

        return F.transform(F.sequence(F.lit(0), w * h * each - 1), value)

    px = let(place, F.flatten(F.transform("tiles", lambda t: t["px"])), F.col("one.width"), F.col("one.height"))
    new = {"px": floats(px), **{c: (F.col(f"one.{c}") * side).cast("int") for c in ("width", "height")}}
    return groups.select(*[new.get(c, F.col(c if c in KEY else f"one.{c}")).alias(c) for c in df.columns])


def to_rgb(df: DataFrame) -> DataFrame:
    """Test frames in colour: v, 255 - v, v div 2."""
    px = F.flatten(F.transform("px", lambda v: F.array(v, F.lit(255.0).cast("float") - v, F.floor(v / 2).cast("float"))))
    return df.withColumn("px", floats(px)).withColumn("pix_fmt", F.lit("RGB_8"))


def pixels(df: DataFrame) -> DataFrame:
    """The PIXELS view; keys stay, so it needs no shuffle."""
    at = F.posexplode("px").alias("i", "v")
    flat = df.select(*KEY, "width", "height", channels().alias("n"), at)
    return flat.select(*KEY, (F.floor(F.col("i") / F.col("n")) % F.col("width")).cast("int").alias("x"), F.floor(F.col("i") / (F.col("n") * F.col("width"))).cast("int").alias("y"), (F.col("i") % F.col("n")).cast("int").alias("c"), "v")


def with_px(df: DataFrame, px: Column, pix_fmt: str | None = None, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """df with new pixels and, where given, another format or size; all are computed from the old row."""
    new = {"px": floats(px)}
    if pix_fmt:
        new["pix_fmt"] = F.lit(pix_fmt)
    if width is not None:
        new["width"] = width.cast("int")
    if height is not None:
        new["height"] = height.cast("int")
    # under other names first, so that no expression sees a new value
    held = df.withColumns({f"__{name}": value for name, value in new.items()})
    return held.select([F.col(f"__{c}").alias(c) if c in new else F.col(c) for c in df.columns])
