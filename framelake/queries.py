"""The registered queries of the frame operators, over frames made from the embeddings table and over events and lineitem.

Whole-number frames are returned as text, one row a frame; float frames as one rounded row a pixel. SQL works on the same
tables: {F} are the frames, {P} their pixels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import from_embeddings, pixels, tiled, to_rgb
from .functions import stack
from .operators import filters, geometry, histograms, joins, objects, points, registration, temporal, tiles, user
from .jobs import workloads
from .sources import page_stacks, raw_video, video_format

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_F = """f AS (SELECT CAST(label AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no,
  list_transform(embedding, lambda e: CAST(floor(least(255.0, greatest(0.0, CAST(e AS DOUBLE) * 256 + 128))) AS INTEGER)) AS px FROM embeddings)"""
_P = _F + ", p AS (SELECT stream_id, frame_no, i % 8 AS x, i // 8 AS y, px[i + 1] AS v FROM f, (SELECT unnest(range(64)) AS i))"
_TEXT = "SELECT stream_id, frame_no, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x) AS px FROM r GROUP BY stream_id, frame_no"
_ROUND = "SELECT stream_id, frame_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS v FROM r"
_COLOUR = _F + ", p AS (SELECT stream_id, frame_no, i % 8 AS x, i // 8 AS y, px[i + 1] AS r0, 255 - px[i + 1] AS g0, px[i + 1] // 2 AS b0 FROM f, (SELECT unnest(range(64)) AS i))"


def as_text(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "frame_no", F.array_join(F.transform("px", lambda v: v.cast("long").cast("string")), ",").alias("px"))


def as_pixels(df: DataFrame) -> DataFrame:
    return pixels(df).select("stream_id", "frame_no", "x", "y", F.round(F.col("v").cast("double"), 4).alias("v"))


def _grey(name: str, op: Callable[[DataFrame], DataFrame], shape: Callable[[DataFrame], DataFrame], sql: str | None = None, colour: bool = False) -> None:
    """A query of one operator over the frames; sql: CTEs after p that end in r(stream_id, frame_no, x, y, v), or in a SELECT."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = from_embeddings(spark, sf_dir)
        return shape(op(to_rgb(df) if colour else df))

    QUERIES[name] = query
    if sql:
        tail = "" if sql.lstrip().startswith("SELECT") else (_TEXT if shape is as_text else _ROUND)
        ORACLES[name] = f"WITH {_COLOUR if colour else _P}" + (", " if not sql.lstrip().startswith("SELECT") else " ") + sql + " " + tail


def text(name, op, sql=None, colour=False):
    _grey(name, op, as_text, sql, colour)


def rounded(name, op, sql=None, colour=False):
    _grey(name, op, as_pixels, sql, colour)


def other(name, op, shape, sql=None, colour=False):
    _grey(name, op, shape, sql, colour)


_RGB_TEXT = "SELECT stream_id, frame_no, string_agg(CAST(CAST({a} AS BIGINT) AS VARCHAR) || ',' || CAST(CAST({b} AS BIGINT) AS VARCHAR) || ',' || CAST(CAST({c} AS BIGINT) AS VARCHAR), ',' ORDER BY y, x) AS px FROM p GROUP BY stream_id, frame_no"
_V = "r AS (SELECT stream_id, frame_no, x, y, {} AS v FROM p)"

# --- sources: what is written comes back


def _named(d: DataFrame) -> DataFrame:
    """A file's name without the number of its image is the stream."""
    return d.withColumn("stream_id", F.regexp_replace("stream_id", r"_01$", ""))


def _raw_video(d: DataFrame) -> DataFrame:
    folder = raw_video.shared_folder(d.sparkSession, "raw")
    raw_video.write_raw_video(d, folder)
    return _named(raw_video.read_raw_video(d.sparkSession, folder))


def _side_files(d: DataFrame) -> DataFrame:
    folder = raw_video.shared_folder(d.sparkSession, "meta")
    raw_video.write_metadata(points.with_metadata(d, F.struct((F.col("frame_no") * 1001).alias("ts_ns"))), folder)
    return _named(raw_video.read_metadata(d.sparkSession, folder))


def _multi(d: DataFrame) -> DataFrame:
    """Two images a slot, the second upside down; the first isn't recorded. Capture times come from the side files."""
    folder = raw_video.shared_folder(d.sparkSession, "multi")
    raw_video.write_multi(d.unionByName(geometry.flip(d, tb=True).withColumn("img_no", F.lit(1))), folder, ["", "low"])
    back = joins.attach_metadata(raw_video.read_raw_video(d.sparkSession, f"{folder}/*.fvf"), raw_video.read_metadata(d.sparkSession, f"{folder}/*.meta"))
    return back.withColumn("stream_id", F.regexp_replace("stream_id", r"_low$", ""))


def _frame_range(d: DataFrame) -> DataFrame:
    """Frames 5 to 24 of each file, through the data source: other bytes of the files aren't read."""
    folder = raw_video.shared_folder(d.sparkSession, "range")
    raw_video.write_raw_video(d.withColumn("stream_id", F.concat(F.lit("cam "), "stream_id")).unionByName(d.withColumn("stream_id", F.concat(F.lit("cam_"), "stream_id"))), folder)
    back = video_format.read_video(d.sparkSession, folder, 5, 25)
    return _named(back.where("stream_id LIKE 'cam %' AND frame_no BETWEEN 5 AND 24")).withColumn("stream_id", F.regexp_extract("stream_id", r"(\d+)$", 1))


def _records(d: DataFrame) -> DataFrame:
    """Side files of two fields."""
    folder = raw_video.shared_folder(d.sparkSession, "records")
    raw_video.write_metadata(d.withColumn("meta", F.struct((F.col("frame_no") * 3).alias("tick"), (F.col("frame_no") / 4).alias("gain"))), folder, layout="tick:u32,gain:f64")
    return _named(raw_video.read_metadata(d.sparkSession, folder, "tick:u32,gain:f64"))


def _page_stacks(d: DataFrame) -> DataFrame:
    """16-bit pages in chunks of seven, and back."""
    folder = raw_video.shared_folder(d.sparkSession, "pages")
    page_stacks.write_stack(points.convert_format(d, "Y_16"), folder, 7)
    return page_stacks.read_stack(d.sparkSession, folder)


text("a7_read_pages", _page_stacks, _V.format("v * 256"))
text("a1_raw_video", _raw_video, _V.format("v"))
other("a4_write_multi", _multi, lambda d: d.select("stream_id", "frame_no", F.array_join(F.transform("px", lambda v: v.cast("long").cast("string")), ",").alias("px"), "meta.ts_ns"))
ORACLES["a4_write_multi"] = f"WITH {_P}, r AS (SELECT stream_id, frame_no, x, 7 - y AS y, v FROM p), t AS (SELECT stream_id, frame_no, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY y, x) AS px FROM r GROUP BY stream_id, frame_no) SELECT t.*, s.ts_ns FROM t JOIN (SELECT CAST(label AS VARCHAR) AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id * 50000000 AS ts_ns FROM embeddings) s USING (stream_id, frame_no)"
other("a5_metadata", _side_files, lambda d: d.select("stream_id", "frame_no", "meta.ts_ns"), "SELECT stream_id, frame_no, frame_no * 1001 AS ts_ns FROM f")
text("a1_frame_range", _frame_range, "r AS (SELECT * FROM p WHERE frame_no BETWEEN 5 AND 24)")
other("a6_records", _records, lambda d: d.select("stream_id", "frame_no", "meta.tick", "meta.gain"), "SELECT stream_id, frame_no, frame_no * 3 AS tick, frame_no / 4 AS gain FROM f")

# --- point operators
text("b1_rgb8_to_y8", lambda d: points.convert_format(d, "Y_8"), _V.format("(r0 + g0 + b0) // 3"), True)
text("b1_y8_to_y16", lambda d: points.convert_format(d, "Y_16"), _V.format("v * 256"))
text("b1_rgb8_to_y16", lambda d: points.convert_format(d, "Y_16"), _V.format("(r0 + g0 + b0) * 256 // 3"), True)
rounded("b1_y8_to_y_f32", lambda d: points.convert_format(d, "Y_F32"), _V.format("(v + 0.5::DOUBLE) / 256"))
text("b1_float_round_trip", lambda d: points.convert_format(points.convert_format(d, "Y_F32"), "Y_8"), _V.format("v"))
text("b1_rgb8_to_bgra", lambda d: points.convert_format(d, "BGRA"), _RGB_TEXT.format(a="b0", b="g0", c="r0").replace("CAST(CAST(r0 AS BIGINT) AS VARCHAR)", "CAST(CAST(r0 AS BIGINT) AS VARCHAR) || ',255'"), True)
text("b1_rgb8_to_rgba", lambda d: points.convert_format(d, "RGBA"), _RGB_TEXT.format(a="r0", b="g0", c="b0").replace("CAST(CAST(b0 AS BIGINT) AS VARCHAR)", "CAST(CAST(b0 AS BIGINT) AS VARCHAR) || ',255'"), True)
rounded("b2_to_y_f32", points.to_y_f32, _V.format("v / 256::DOUBLE"))
rounded("b2_rgb_to_y_f32", points.to_y_f32, _V.format("(r0 + g0 + b0) / 768::DOUBLE"), True)
other("b3_to_rgb_f32", lambda d: points.channel(points.to_rgb_f32(d), 1), as_pixels, "r AS (SELECT stream_id, frame_no, x, y, g0 / 256::DOUBLE AS v FROM p)", True)
for _c, _name in ((0, "red"), (2, "blue")):
    other(f"b3_to_rgb_f32_{_name}", lambda d, c=_c: points.channel(points.to_rgb_f32(d), c), as_pixels, f"r AS (SELECT stream_id, frame_no, x, y, {'rgb'[_c]}0 / 256::DOUBLE AS v FROM p)", True)
text("b1_y16_to_y8", lambda d: points.convert_format(points.convert_format(d, "Y_16"), "Y_8"), _V.format("v"))
text("b4_to_y8", lambda d: points.to_y8(points.to_y_f32(d), 0.99), _V.format("CASE WHEN v / 256::DOUBLE * 256 * 0.99::DOUBLE >= 255 THEN 255 ELSE floor(v / 256::DOUBLE * 256 * 0.99::DOUBLE + 0.5::DOUBLE) END"))
text("b5_to_rgb8", points.to_rgb8, _RGB_TEXT.format(a="v", b="v", c="v"))
text("b6_tonemap", lambda d: points.tonemap(d, 0.5), _V.format("floor(sqrt(v / 255::DOUBLE) * 255 + 0.5::DOUBLE)"))
rounded("b6_tonemap_float", lambda d: points.tonemap(points.to_y_f32(d), 1.5), _V.format("pow(v / 256::DOUBLE, 1.5::DOUBLE)"))
rounded("b7_gamma", lambda d: points.gamma(d, 2.2), _V.format("pow(v / 255::DOUBLE, 2.2::DOUBLE) * 255"))
rounded("b8_sigmoid", lambda d: points.sigmoid(points.to_y_f32(d)), _V.format("1 / (1 + exp(-(v / 256::DOUBLE - 0.5::DOUBLE) * 5))"))
text("b9_threshold_gt", lambda d: points.threshold_gt(d, 128), _V.format("CASE WHEN v > 128 THEN 1 ELSE 0 END"))
text("b10_threshold_ge", lambda d: points.threshold_ge(d, 128), _V.format("CASE WHEN v >= 128 THEN 255 ELSE 0 END"))
rounded("b11_luma", points.luma, _V.format("r0 * 0.2125::DOUBLE + g0 * 0.7154::DOUBLE + b0 * 0.0721::DOUBLE"), True)
text("b12_palette_remap", lambda d: points.palette_remap(d, [255 - i for i in range(256)]), _V.format("255 - v"))
text("b13_identity_lut", lambda d: points.palette_remap(d.withColumn("lut", points.identity_lut()), "lut"), _V.format("v"))
text("b14_add_noise", lambda d: points.add_noise(d, 0.05, 7))
text("b15_channel", lambda d: points.channel(d, 2), _V.format("b0"), True)
text("b16_enabled", lambda d: points.tonemap(d, 0.5, enabled=False), _V.format("v"))
text("b17_frames", lambda d: points.frames(d, 3, 30, 4), "r AS (SELECT * FROM p WHERE frame_no >= 3 AND frame_no < 30 AND frame_no % 4 = 0)")
other("b18_with_metadata", lambda d: points.with_metadata(d, F.struct((F.col("frame_no") * 1000).alias("ts_ns"))), lambda d: d.select("stream_id", "frame_no", "meta.ts_ns"), "SELECT stream_id, frame_no, frame_no * 1000 AS ts_ns FROM f")

# --- geometry
text("c1_crop", lambda d: geometry.crop(d, 2, 1, 4, 5), "r AS (SELECT * FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5)")
text("c2_flip", lambda d: geometry.flip(d, True, True), "r AS (SELECT stream_id, frame_no, 7 - x AS x, 7 - y AS y, v FROM p)")
text("c3_rotate90", lambda d: geometry.rotate90(d, 1), "r AS (SELECT stream_id, frame_no, 7 - y AS x, x AS y, v FROM p)")
text("c3_rotate270", lambda d: geometry.rotate90(d, 3), "r AS (SELECT stream_id, frame_no, y AS x, 7 - x AS y, v FROM p)")
text("c4_transform2d", lambda d: geometry.transform2d(d, 0.5, 0.25, -0.25, 0.5), """o AS (SELECT stream_id, frame_no, x, y, CAST(trunc((x - 4) * 0.5::DOUBLE + (y - 4) * 0.25::DOUBLE + 4.5::DOUBLE) AS INTEGER) AS s,
  CAST(trunc((x - 4) * -0.25::DOUBLE + (y - 4) * 0.5::DOUBLE + 4.5::DOUBLE) AS INTEGER) AS t FROM p), r AS (SELECT o.stream_id, o.frame_no, o.x, o.y, coalesce(p.v, 0) AS v FROM o LEFT JOIN p ON p.stream_id = o.stream_id AND p.frame_no = o.frame_no AND p.x = o.s AND p.y = o.t)""")
text("c5_translate", lambda d: geometry.translate(d, 2, -1), "r AS (SELECT o.stream_id, o.frame_no, o.x, o.y, coalesce(p.v, 0) AS v FROM p o LEFT JOIN p ON p.stream_id = o.stream_id AND p.frame_no = o.frame_no AND p.x = o.x - 2 AND p.y = o.y + 1)")
rounded("c5_translate_fraction", lambda d: geometry.translate(d, 0.5, 0.0), "r AS (SELECT o.stream_id, o.frame_no, o.x, o.y, coalesce((o.v + p.v) / 2::DOUBLE, 0) AS v FROM p o LEFT JOIN p ON p.stream_id = o.stream_id AND p.frame_no = o.frame_no AND p.x = o.x - 1 AND p.y = o.y)")
text("c6_affine", lambda d: geometry.affine(d, [[2, 0], [0, 1]]), "r AS (SELECT o.stream_id, o.frame_no, o.x, o.y, p.v FROM p o JOIN p ON p.stream_id = o.stream_id AND p.frame_no = o.frame_no AND p.x = CAST(floor(o.x / 2::DOUBLE + 0.5::DOUBLE) AS INTEGER) AND p.y = o.y)")
text("c7_resize_nearest", lambda d: geometry.resize_nearest(d, 5, 11), "o AS (SELECT i % 5 AS x, i // 5 AS y FROM (SELECT unnest(range(55)) AS i)), r AS (SELECT stream_id, frame_no, o.x, o.y, v FROM o JOIN p ON p.x = o.x * 8 // 5 AND p.y = o.y * 8 // 11)")
rounded("c8_downsample_box", lambda d: geometry.downsample_box(d, 2), "r AS (SELECT stream_id, frame_no, x // 2 AS x, y // 2 AS y, avg(v) AS v FROM p GROUP BY stream_id, frame_no, x // 2, y // 2)")
# kernel of 4 with sigma 1 from twice the output place on; the result stands one further on, outside it is 0
rounded("c9_downsample_gauss", lambda d: geometry.downsample_gauss(points.to_y_f32(d), 2.0, 4), """k AS (SELECT i, exp(-(i - 1.5::DOUBLE) * (i - 1.5::DOUBLE) / 2) AS w FROM (SELECT unnest(range(4)) AS i)), n AS (SELECT i, w / sum(w) OVER () AS w FROM k),
  q AS (SELECT p.stream_id, p.frame_no, o.x, o.y, sum(a.w * b.w * p.v / 256::DOUBLE) AS v FROM (SELECT x, y FROM (SELECT unnest(range(1, 4)) AS x), (SELECT unnest(range(1, 4)) AS y)) AS o, n a, n b, p
    WHERE p.x = 2 * (o.x - 1) + a.i AND p.y = 2 * (o.y - 1) + b.i GROUP BY p.stream_id, p.frame_no, o.x, o.y),
  r AS (SELECT f.stream_id, f.frame_no, i % 4 AS x, i // 4 AS y, coalesce(q.v, 0) AS v FROM f CROSS JOIN (SELECT unnest(range(16)) AS i) LEFT JOIN q ON q.stream_id = f.stream_id AND q.frame_no = f.frame_no AND q.x = i % 4 AND q.y = i // 4)""")

# --- neighbourhood filters
_SIDE = "CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN {} ELSE {} END"
_NEAR = """w AS (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS q, lag(v) OVER c AS t, lead(v) OVER c AS b FROM {src}
  WINDOW h AS (PARTITION BY stream_id, frame_no, y ORDER BY x), c AS (PARTITION BY stream_id, frame_no, x ORDER BY y)),
  n AS (SELECT *, lag(t) OVER h AS tl, lead(t) OVER h AS tr, lag(b) OVER h AS bl, lead(b) OVER h AS br FROM w WINDOW h AS (PARTITION BY stream_id, frame_no, y ORDER BY x))"""


def _cells(body: str, edge: str = "0", src: str = "p") -> str:
    return _NEAR.format(src=src) + ", r AS (SELECT stream_id, frame_no, x, y, " + _SIDE.format(body, edge) + " AS v FROM n)"


def _minmax(fn: str, name: str, src: str) -> str:
    return f"{name}0 AS (SELECT stream_id, frame_no, x, y, {fn}(v) OVER (PARTITION BY stream_id, frame_no, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src}), {name} AS (SELECT stream_id, frame_no, x, y, " + _SIDE.format(f"{fn}(v) OVER (PARTITION BY stream_id, frame_no, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "0") + f" AS v FROM {name}0)"


text("d1_integral", filters.integral, "a AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, frame_no, y ORDER BY x) AS v FROM p), r AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, frame_no, x ORDER BY y) AS v FROM a)")
rounded("d2_box_mean", lambda d: filters.box(d, 3), _cells("(v + l + q + t + b + tl + tr + bl + br) / 9::DOUBLE"))
text("d2_box_direct", lambda d: filters.box(d, 3, "direct"), "a AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, frame_no, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) // 3 AS v FROM p), r AS (SELECT stream_id, frame_no, x, y, " + _SIDE.format("sum(v) OVER (PARTITION BY stream_id, frame_no, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) // 3", "0") + " AS v FROM a)")
text("d2_box_integral", lambda d: filters.box(d, 3, "integral"), _cells("floor((v + l + q + t + b + tl + tr + bl + br) / 9::DOUBLE + 0.5::DOUBLE)"))
other("d3_box_sigma", lambda d: d.withColumn("sigma", F.round(F.lit(filters.box_sigma(5)), 6)), lambda d: d.select("stream_id", "frame_no", "sigma"), "SELECT stream_id, frame_no, round(sqrt((5 * 5 - 1) / 12::DOUBLE), 6) AS sigma FROM f")
_W = "exp(-0.5::DOUBLE)"
rounded("d4_gauss", lambda d: filters.gauss(d, 2.0, 3), _cells(f"(v + {_W} * (l + q + t + b) + {_W} * {_W} * (tl + tr + bl + br)) / ((1 + 2 * {_W}) * (1 + 2 * {_W}))"))
rounded("d5_gauss_approx", lambda d: filters.gauss_approx(d, 3, 1), _cells("(v + l + q + t + b + tl + tr + bl + br) / 9::DOUBLE"))
rounded("d6_gradient_x", filters.gradient_x, _cells("(3 * (tr - tl) + 10 * (q - l) + 3 * (br - bl)) / 32::DOUBLE"))
rounded("d6_gradient_y", filters.gradient_y, _cells("(3 * (bl - tl) + 10 * (b - t) + 3 * (br - tr)) / 32::DOUBLE"))
text("d7_edge_detect", filters.edge_detect, _cells("12 * v - 2 * (t + b + l + q) - (tl + tr + bl + br)"))
text("d8_laplacian", filters.laplacian, "m AS (SELECT stream_id, frame_no, x, y, v, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS xa, CASE WHEN x = 7 THEN 6 ELSE x + 1 END AS xb, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS ya, CASE WHEN y = 7 THEN 6 ELSE y + 1 END AS yb FROM p), r AS (SELECT m.stream_id, m.frame_no, m.x, m.y, 2 * (f.px[m.ya * 8 + m.xa + 1] + f.px[m.ya * 8 + m.xb + 1] + f.px[m.yb * 8 + m.xa + 1] + f.px[m.yb * 8 + m.xb + 1]) - 8 * m.v AS v FROM m JOIN f USING (stream_id, frame_no))")
text("d9_median_quadrant", lambda d: filters.median_quadrant(d, 2), _cells("greatest(least(v, l, t, tl), least(v, q, t, tr), least(v, l, b, bl), least(v, q, b, br))"))
text("d10_erode", lambda d: filters.erode(d, 3), _minmax("min", "r", "p"))
text("d10_dilate", lambda d: filters.dilate(d, 3), _minmax("max", "r", "p"))
text("d11_absdiff", lambda d: filters.absdiff(temporal.with_previous(d).where("prev IS NOT NULL"), "prev"), "r AS (SELECT a.stream_id, a.frame_no, a.x, a.y, abs(a.v - b.v) AS v FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no + 1 AND a.x = b.x AND a.y = b.y)")
text("d12_morph_open", lambda d: filters.morph(d, ["ERODE", "DILATE"]), _minmax("min", "e", "p") + ", " + _minmax("max", "r", "e"))
text("d12_morph_top_hat", lambda d: filters.morph(d, ["ERODE", "DILATE", "SOURCE_MINUS", "THRESHOLD"], t=40), _minmax("min", "e", "p") + ", " + _minmax("max", "o", "e") + ", r AS (SELECT stream_id, frame_no, x, y, CASE WHEN abs(p.v - o.v) >= 40 THEN 255 ELSE 0 END AS v FROM p JOIN o USING (stream_id, frame_no, x, y))")
rounded("d13_unsharp", lambda d: filters.unsharp(d, 2.0, 0.5), _cells("(v - (v + exp(-8::DOUBLE) * (l + q + t + b) + exp(-16::DOUBLE) * (tl + tr + bl + br)) / ((1 + 2 * exp(-8::DOUBLE)) * (1 + 2 * exp(-8::DOUBLE)))) * 2 + v", "v"))
other("d14_adaptive_threshold", lambda d: filters.adaptive_threshold(d, 5, 1, 0.02, noise_k=3), lambda d: d.select("stream_id", "frame_no", F.array_join(F.transform("px", lambda v: v.cast("long").cast("string")), ",").alias("px"), F.round("share", 6).alias("share")), None)
ORACLES["d14_adaptive_threshold"] = f"WITH {_P}" + """, z AS (SELECT a.stream_id, a.frame_no, a.x, a.y, floor(sum(CASE WHEN abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 THEN b.v ELSE 0 END) / 9::DOUBLE + 0.5::DOUBLE) AS fine,
  CASE WHEN a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 5 THEN floor(sum(b.v) / 25::DOUBLE + 0.5::DOUBLE) ELSE 255 END AS wide
  FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.stream_id, a.frame_no, a.x, a.y),
  r AS (SELECT *, CASE WHEN fine - 5 > wide THEN 255 ELSE 0 END AS v FROM z)
  SELECT stream_id, frame_no, string_agg(CAST(v AS VARCHAR), ',' ORDER BY y, x) AS px, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM r GROUP BY stream_id, frame_no"""
rounded("d15_equalise_local", lambda d: filters.equalise_local(d, 100.0, 3), _cells("CASE WHEN v + l + q + t + b + tl + tr + bl + br = 0 THEN 0 ELSE v * 100 / ((v + l + q + t + b + tl + tr + bl + br) / 9::DOUBLE) END"))
rounded("d16_equalise_local_drift", lambda d: histograms.equalise_local_drift(d, 0.4, 0.1, 128.0), None)
rounded("d17_retinex", lambda d: filters.retinex(points.to_y_f32(d), 2, 2))
text("d18_clahe", lambda d: filters.clahe(d, 2.0, 2))
text("d19_pulse_filter", lambda d: filters.pulse_filter(points.palette_remap(d, [i // 32 * 32 for i in range(256)]), 3))

# --- aggregations
other("e1_histogram", lambda d: histograms.histogram(d, 3, 5), lambda d: d.select("stream_id", "frame_no", "bin", "n"), "SELECT stream_id, frame_no, v AS bin, count(*) * 3 AS n FROM p WHERE frame_no % 5 = 0 AND (y * 8 + x) % 3 = 0 GROUP BY stream_id, frame_no, v")
other("e2_frame_mean", histograms.with_mean, lambda d: d.select("stream_id", "frame_no", F.round("mean", 6).alias("mean")), "SELECT stream_id, frame_no, round(avg(v), 6) AS mean FROM p GROUP BY stream_id, frame_no")
text("e3_equalise", lambda d: histograms.equalise(d, 0.5), "m AS (SELECT stream_id, frame_no, sum(v) / 64::DOUBLE AS m FROM p GROUP BY stream_id, frame_no), r AS (SELECT stream_id, frame_no, x, y, CASE WHEN m = 0 THEN v ELSE least(255, floor(v * (0.5::DOUBLE * 255) / m)) END AS v FROM p JOIN m USING (stream_id, frame_no))")
text("e4_equalise_drift", lambda d: histograms.equalise_drift(d, 128.0, 0.1), None)
other("e5_ref_hist", lambda d: d.select("stream_id", "frame_no", F.posexplode(histograms.ref_hist(F.lit(1000))).alias("bin", "n")), lambda d: d, "SELECT stream_id, frame_no, CAST(b AS INTEGER) AS bin, CAST(floor((b + 1) / 256::DOUBLE * 1000 + 0.5::DOUBLE) - CASE WHEN b > 0 THEN floor(b / 256::DOUBLE * 1000 + 0.5::DOUBLE) ELSE 0 END AS BIGINT) AS n FROM f, (SELECT unnest(range(256)) AS b)")
_HIST = "h AS (SELECT stream_id, frame_no, b AS bin, count(p.v) AS n FROM f CROSS JOIN (SELECT unnest(range(256)) AS b) LEFT JOIN p USING (stream_id, frame_no) WHERE p.v = b OR TRUE GROUP BY ALL)"
_HIST = "h AS (SELECT stream_id, frame_no, b AS bin, sum(CASE WHEN p.v = b THEN 1 ELSE 0 END) AS n FROM p CROSS JOIN (SELECT unnest(range(256)) AS b) GROUP BY stream_id, frame_no, b), c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id, frame_no ORDER BY bin) AS cdf FROM h)"
_MATCH = _HIST + ", g AS (SELECT b AS rb, floor((b + 1) / 256::DOUBLE * 64 + 0.5::DOUBLE) AS ref FROM (SELECT unnest(range(256)) AS b)), l AS (SELECT stream_id, frame_no, bin, coalesce(min(rb), 255) AS lut FROM c LEFT JOIN g ON g.ref > c.cdf - c.n GROUP BY stream_id, frame_no, bin)"
_LUT = "SELECT stream_id, frame_no, string_agg(CAST(lut AS VARCHAR), ',' ORDER BY bin) AS lut FROM l GROUP BY stream_id, frame_no"


def _lut(df: DataFrame) -> DataFrame:
    return df.select("stream_id", "frame_no", F.array_join(F.transform("lut", lambda v: v.cast("string")), ",").alias("lut"))


other("e6_match_map", lambda d: histograms.match_map(histograms.histogram(d)), _lut)
ORACLES["e6_match_map"] = f"WITH {_P}, {_MATCH} {_LUT}"
other("e7_stretch_map", lambda d: histograms.stretch_map(histograms.histogram(d), 0.1, 0.9), _lut)
ORACLES["e7_stretch_map"] = f"WITH {_P}, {_HIST}" + """, k AS (SELECT stream_id, frame_no, coalesce(max(CASE WHEN (cdf - n) / 64::DOUBLE < 0.1::DOUBLE THEN bin END), 0) AS a, coalesce(max(CASE WHEN (cdf - n) / 64::DOUBLE < 0.9::DOUBLE THEN bin END), 255) AS z FROM c GROUP BY stream_id, frame_no),
  l AS (SELECT stream_id, frame_no, bin, CASE WHEN bin < a THEN 0 WHEN bin > z THEN 255 WHEN a = z THEN 255 ELSE CAST(floor((bin - a) / CAST(z - a AS DOUBLE) * 255) AS INTEGER) END AS lut FROM c JOIN k USING (stream_id, frame_no)) """ + _LUT
_REMAP = "r AS (SELECT p.stream_id, p.frame_no, p.x, p.y, l.lut AS v FROM p JOIN l ON l.stream_id = p.stream_id AND l.frame_no = {} AND l.bin = p.v)"
text("e8_hist_equalise", histograms.hist_equalise, _MATCH + ", " + _REMAP.format("p.frame_no"))
text("e9_cdf_equalise", histograms.cdf_equalise, _HIST + ", l AS (SELECT stream_id, frame_no, bin, floor(cdf * 255 / 64::DOUBLE) AS lut FROM c), " + _REMAP.format("p.frame_no"))
text("e10_auto_contrast", histograms.auto_contrast, "m AS (SELECT stream_id, frame_no, min(v) AS a, max(v) AS z FROM p GROUP BY stream_id, frame_no), r AS (SELECT stream_id, frame_no, x, y, CASE WHEN a = z THEN 0 ELSE floor((v - a) / CAST(z - a AS DOUBLE) * 255) END AS v FROM p JOIN m USING (stream_id, frame_no))")
text("e11_equalize_hist", histograms.equalize_hist, _HIST + ", m AS (SELECT stream_id, frame_no, min(cdf) AS least FROM c WHERE cdf > 0 GROUP BY stream_id, frame_no), l AS (SELECT stream_id, frame_no, bin, CASE WHEN least = 64 THEN bin ELSE greatest(0, floor((cdf - least) * 255::DOUBLE / (64 - least) + 0.5::DOUBLE)) END AS lut FROM c JOIN m USING (stream_id, frame_no)), " + _REMAP.format("p.frame_no"))
text("w3_equalisation", workloads.equalisation, None)
ORACLES["w3_equalisation"] = f"WITH {_P}, q AS (SELECT * FROM p WHERE frame_no % 5 = 0 AND (y * 8 + x) % 3 = 0), h AS (SELECT stream_id, frame_no, b AS bin, sum(CASE WHEN q.v = b THEN 3 ELSE 0 END) AS n FROM q CROSS JOIN (SELECT unnest(range(256)) AS b) GROUP BY stream_id, frame_no, b), c AS (SELECT *, sum(n) OVER (PARTITION BY stream_id, frame_no ORDER BY bin) AS cdf FROM h), g AS (SELECT b AS rb, floor((b + 1) / 256::DOUBLE * 66 + 0.5::DOUBLE) AS ref FROM (SELECT unnest(range(256)) AS b)), l AS (SELECT stream_id, frame_no, bin, coalesce(min(rb), 255) AS lut FROM c LEFT JOIN g ON g.ref > c.cdf - c.n GROUP BY stream_id, frame_no, bin), " + _REMAP.format("p.frame_no - p.frame_no % 5") + " " + _TEXT
other("e13_num_frames", histograms.num_frames, lambda d: d, "SELECT stream_id, count(*) AS frames FROM f GROUP BY stream_id")

# --- time
rounded("f1_average", lambda d: temporal.average(d, 3), "r AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, x, y ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / 8::DOUBLE AS v FROM p)")
rounded("f2_average_adaptive", lambda d: temporal.average_adaptive(d, 0.02))
ORACLES["f2_average_adaptive"] = f"WITH RECURSIVE {_P}, " + """m AS (SELECT stream_id, frame_no, x, y, v, CAST(v AS DOUBLE) AS m FROM p WHERE frame_no = 0
  UNION ALL SELECT stream_id, frame_no, x, y, v, (1 - t) * m + v * t FROM (SELECT p.*, m.m, least(1::DOUBLE, greatest(0.1::DOUBLE, abs(p.v - m.v) * 0.02::DOUBLE)) AS t
    FROM m JOIN p ON p.stream_id = m.stream_id AND p.frame_no = m.frame_no + 1 AND p.x = m.x AND p.y = m.y)), r AS (SELECT stream_id, frame_no, x, y, m AS v FROM m) """ + _ROUND
rounded("f3_beat", lambda d: temporal.beat(points.to_y_f32(d), 3), "s AS (SELECT stream_id, frame_no, x, y, sum(v / 256::DOUBLE * cos(pi() * frame_no / 2)) OVER w AS a, sum(v / 256::DOUBLE * sin(pi() * frame_no / 2)) OVER w AS b FROM p WINDOW w AS (PARTITION BY stream_id, x, y ORDER BY frame_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), r AS (SELECT stream_id, frame_no, x, y, 2.625::DOUBLE * (a * a + b * b) + 0.5::DOUBLE AS v FROM s)")
text("f4_history", lambda d: temporal.history(d, 3).withColumn("px", F.col("past")), "r AS (SELECT a.stream_id, a.frame_no, a.x, a.y, b.v FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.x = b.x AND a.y = b.y AND b.frame_no = greatest(0, a.frame_no - 3))")
_PREV = "d AS (SELECT a.*, b.v AS pv FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no + 1 AND a.x = b.x AND a.y = b.y)"
rounded("f5_deinterlace_linear", lambda d: temporal.deinterlace(d, "linear"), _PREV + ", r AS (SELECT stream_id, frame_no, x, y, CASE WHEN (y + 1) % 2 = frame_no % 2 THEN v ELSE (v + pv) / 2::DOUBLE END AS v FROM d)")
text("f6_deinterlace_interframe", lambda d: temporal.deinterlace(d, "interframe"), _PREV + ", e AS (SELECT *, lag(v) OVER c AS t, lead(v) OVER c AS b FROM d WINDOW c AS (PARTITION BY stream_id, frame_no, x ORDER BY y)), r AS (SELECT stream_id, frame_no, x, y, CASE WHEN (y + 1) % 2 = frame_no % 2 OR y < 2 OR y = 7 THEN v ELSE t + b + pv - least(t, b, pv) - greatest(t, b, pv) END AS v FROM e)")
rounded("f7_deinterlace_smooth", lambda d: temporal.deinterlace(d, "smooth"), _PREV + ", e AS (SELECT *, lag(v + pv) OVER c AS t, lead(v + pv) OVER c AS b, lag(v + pv) OVER h AS l, lead(v + pv) OVER h AS q FROM d WINDOW c AS (PARTITION BY stream_id, frame_no, x ORDER BY y), h AS (PARTITION BY stream_id, frame_no, y ORDER BY x)), r AS (SELECT stream_id, frame_no, x, y, CASE WHEN (y + 1) % 2 = frame_no % 2 OR x IN (0, 7) OR y IN (0, 7) THEN v ELSE (t + b + l + q) / 8::DOUBLE END AS v FROM e)")
rounded("f8_background_mean", lambda d: temporal.background_model(d, 0.25).withColumn("px", F.col("bg_mean").cast("array<float>")), "r AS (SELECT a.stream_id, a.frame_no, a.x, a.y, sum(b.v * CASE WHEN b.frame_no = 0 THEN 1 ELSE 0.25::DOUBLE END * pow(0.75::DOUBLE, a.frame_no - b.frame_no)) AS v FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.x = b.x AND a.y = b.y AND b.frame_no <= a.frame_no GROUP BY a.stream_id, a.frame_no, a.x, a.y)")
_MODEL = """r AS (SELECT stream_id, frame_no, x, y, v, CAST(v AS DOUBLE) AS m, 100::DOUBLE AS s FROM p WHERE frame_no = 0
  UNION ALL SELECT stream_id, frame_no, x, y, v, m, 0.95::DOUBLE * s + (v - floor(m)) * (v - floor(m)) * 0.05::DOUBLE FROM (
    SELECT p.stream_id, p.frame_no, p.x, p.y, p.v, 0.95::DOUBLE * r.m + p.v * 0.05::DOUBLE AS m, r.s FROM r JOIN p ON p.stream_id = r.stream_id AND p.frame_no = r.frame_no + 1 AND p.x = r.x AND p.y = r.y))"""
rounded("f8_background_variance", lambda d: temporal.background_model(d, 0.05).withColumn("px", F.col("bg_var").cast("array<float>")))
ORACLES["f8_background_variance"] = f"WITH RECURSIVE {_P}, {_MODEL} SELECT stream_id, frame_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 4) AS v FROM r"
other("f9_motion_cells", lambda d: temporal.motion_cells(temporal.background_model(d, 0.05), 2.5, 4), lambda d: d.select("stream_id", "frame_no", "cell_x", "cell_y", "marked"))
other("f9_motion", lambda d: temporal.motion(d, 0.05, 2.5, 4), lambda d: d.select("stream_id", "frame_no", "cell_x", "cell_y", "marked"))
ORACLES["f9_motion"] = ORACLES["f9_motion_cells"] = f"WITH RECURSIVE {_P}, {_MODEL} SELECT stream_id, frame_no, CAST(x // 4 AS INTEGER) AS cell_x, CAST(y // 4 AS INTEGER) AS cell_y, bool_or(abs(v - m) / sqrt(s) > 2.5::DOUBLE) AS marked FROM r GROUP BY ALL"


def _simple_cells(d: DataFrame) -> DataFrame:
    """Cells marked by a plain rule that SQL shares: the frame's cell has a value over 230."""
    p = pixels(d)
    return p.groupBy("stream_id", "frame_no", "img_no", F.floor(F.col("x") / 4).cast("int").alias("cell_x"), F.floor(F.col("y") / 4).cast("int").alias("cell_y")).agg((F.max("v") > 190).alias("marked"))


_MARK = "k AS (SELECT stream_id, frame_no, x // 4 AS cell_x, y // 4 AS cell_y, max(v) > 190 AS marked FROM p GROUP BY stream_id, frame_no, x // 4, y // 4), i AS (SELECT *, sum(CASE WHEN marked THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id, cell_x, cell_y ORDER BY frame_no) AS island FROM k), u AS (SELECT *, sum(CASE WHEN marked THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, cell_x, cell_y, island ORDER BY frame_no) AS run FROM i)"
other("f10_persistent", lambda d: temporal.persistent(_simple_cells(d), 2), lambda d: d.select("stream_id", "frame_no", "cell_x", "cell_y", "run", "detected"))
ORACLES["f10_persistent"] = f"WITH {_P}, {_MARK} SELECT stream_id, frame_no, CAST(cell_x AS INTEGER) AS cell_x, CAST(cell_y AS INTEGER) AS cell_y, CAST(run AS BIGINT) AS run, run > 2 AS detected FROM u"
text("f11_motion_overlay", lambda d: temporal.motion_overlay(d, temporal.persistent(_simple_cells(d), 2), 4), _MARK + ", r AS (SELECT p.stream_id, p.frame_no, p.x, p.y, CASE WHEN u.run > 2 THEN p.v // 2 + 128 ELSE p.v END AS v FROM p JOIN u ON u.stream_id = p.stream_id AND u.frame_no = p.frame_no AND u.cell_x = p.x // 4 AND u.cell_y = p.y // 4)")
text("f12_motion_frames", lambda d: temporal.motion_frames(d, temporal.persistent(_simple_cells(d), 4)), _MARK + ", r AS (SELECT * FROM p WHERE EXISTS (SELECT 1 FROM u WHERE u.stream_id = p.stream_id AND u.frame_no = p.frame_no AND run > 4))")
text("f13_subtract_reference", lambda d: temporal.subtract_reference(d, 10, 20), "r AS (SELECT a.stream_id, a.frame_no, a.x, a.y, CASE WHEN abs(a.v - b.v) > 20 THEN 255 ELSE 0 END AS v FROM p a JOIN p b ON a.stream_id = b.stream_id AND a.x = b.x AND a.y = b.y AND b.frame_no = a.frame_no - a.frame_no % 10)")


def _h(d: DataFrame) -> DataFrame:
    return d.select("stream_id", "frame_no", "img_no", (F.col("frame_no") % 5 - 2).cast("double").alias("hx"), (F.col("frame_no") % 3 - 1).cast("double").alias("hy"))


other("f14_register_pairs", lambda d: registration.register_pairs(points.to_y_f32(tiled(d))), lambda d: d.select("stream_id", "frame_no", F.round("hx", 4).alias("hx"), F.round("hy", 4).alias("hy")))
other("f15_accumulate_shift", lambda d: registration.accumulate_shift(_h(d), 0.5, 1.0), lambda d: d.select("stream_id", "frame_no", F.round("cum_hx", 6).alias("cum_hx"), F.round("cum_hy", 6).alias("cum_hy")))
_CUM = "u AS (SELECT a.stream_id, a.frame_no, coalesce(sum((b.frame_no % 5 - 2) * pow(0.5::DOUBLE, a.frame_no - b.frame_no + 1)), 0) AS cx, coalesce(CAST(sum(b.frame_no % 3 - 1) AS DOUBLE), 0) AS cy FROM f a LEFT JOIN f b ON a.stream_id = b.stream_id AND b.frame_no <= a.frame_no AND b.frame_no > 2 GROUP BY a.stream_id, a.frame_no)"
ORACLES["f15_accumulate_shift"] = f"WITH {_F}, {_CUM} SELECT stream_id, frame_no, round(cx, 6) AS cum_hx, round(cy, 6) AS cum_hy FROM u"
text("f16_stabilise", lambda d: registration.stabilise(d, registration.accumulate_shift(_h(d), 0.5, 1.0)), _CUM + ", r AS (SELECT o.stream_id, o.frame_no, o.x, o.y, coalesce(p.v, 0) AS v FROM p o JOIN u ON u.stream_id = o.stream_id AND u.frame_no = o.frame_no LEFT JOIN p ON p.stream_id = o.stream_id AND p.frame_no = o.frame_no AND p.x = o.x - floor(cx + 0.5::DOUBLE) AND p.y = o.y - floor(cy + 0.5::DOUBLE))")
other("f17_register_rois", lambda d: registration.register_rois(points.to_y_f32(tiled(d)), [(0, 0, 24, 24), (8, 8, 24, 24)]), lambda d: d.select("stream_id", "frame_no", F.round("hx", 4).alias("hx"), F.round("hy", 4).alias("hy")))
rounded("f18_dewarp", lambda d: registration.dewarp(points.to_y_f32(d), 0.9))
text("w1_motion_detection", lambda d: workloads.motion_detection(tiled(d), window=5, cell=4)[0])
other("w2_enhancement", lambda d: points.channel(workloads.enhancement(to_rgb(tiled(d))), 0), as_pixels)

# --- several streams


def _places(d: DataFrame) -> DataFrame:
    """(stream_id, source_no, before): streams by number from 0, and the one before (of the first, the last)."""
    every = d.select("stream_id").distinct()  # a row a stream
    order = Window.orderBy(F.col("stream_id").cast("int"))
    return every.select("stream_id", (F.row_number().over(order) - 1).alias("source_no"), F.coalesce(F.lag("stream_id").over(order), F.last("stream_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))


def _pair(d: DataFrame) -> DataFrame:
    """The next stream (after the last comes the first) under this stream's name."""
    return d.join(_places(d), "stream_id").withColumn("stream_id", F.col("before")).select(*d.columns)


_PLACES = "w AS (SELECT stream_id, row_number() OVER (ORDER BY CAST(stream_id AS INTEGER)) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT stream_id FROM f))"
_TWO = _PLACES + ", s AS (SELECT a.*, b.v AS o FROM p a JOIN w ON w.stream_id = a.stream_id JOIN w z ON z.place = (w.place + 1) % w.n JOIN p b ON b.stream_id = z.stream_id AND a.frame_no = b.frame_no AND a.x = b.x AND a.y = b.y)"
_ON = ["stream_id", "frame_no", "img_no"]
rounded("g1_diff_and_scale", lambda d: joins.diff_and_scale(d, _pair(d), 0.5, _ON), _TWO + ", r AS (SELECT stream_id, frame_no, x, y, abs((v - o) * 0.5::DOUBLE) AS v FROM s)")
rounded("g2_masked_gain", lambda d: joins.masked_gain(d, _pair(d), 1.5, _ON), _TWO + ", r AS (SELECT stream_id, frame_no, x, y, (v - o) * 1.5::DOUBLE + o AS v FROM s)")


def _cameras(d: DataFrame) -> DataFrame:
    """Streams 3k, 3k + 1, 3k + 2 as the images of one slot; the last slot may have fewer."""
    n = F.col("stream_id").cast("int")
    return d.withColumn("img_no", n % 3).withColumn("stream_id", F.floor(n / 3).cast("string"))


def _setup(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0), (1, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0), (2, 0.0, -1.0, 1.0, 0.0, 0.25, 0.0, 1.0)], "img_no int, x double, y double, scale double, angle double, r double, g double, b double")


other("g3_fuse", lambda d: points.channel(joins.fuse(_cameras(d), _setup(d)), 0), as_pixels)
ORACLES["g3_fuse"] = f"WITH {_P}, q AS (SELECT CAST(CAST(stream_id AS INTEGER) // 3 AS VARCHAR) AS stream_id, CAST(stream_id AS INTEGER) % 3 AS img, frame_no, x, y, v FROM p), g AS (SELECT DISTINCT stream_id, frame_no, x, y FROM q), r AS (SELECT g.stream_id, g.frame_no, g.x, g.y, coalesce(a.v, 0) + 0.25::DOUBLE * coalesce(c.v, 0) AS v FROM g LEFT JOIN q a ON a.img = 0 AND a.stream_id = g.stream_id AND a.frame_no = g.frame_no AND a.x = g.x AND a.y = g.y LEFT JOIN q c ON c.img = 2 AND c.stream_id = g.stream_id AND c.frame_no = g.frame_no AND c.x = g.x AND c.y = g.y + 1) {_ROUND}"


def _all_in_turn(d: DataFrame) -> DataFrame:
    ready = points.convert_format(geometry.resize_nearest(d, 4, 4), "Y_8").join(_places(d).drop("before"), "stream_id")
    return joins.in_turn(ready).withColumn("stream_id", F.lit("mux"))


text("g4_multiplex", _all_in_turn, _PLACES + ", l AS (SELECT min(m) AS last FROM (SELECT max(frame_no) AS m FROM f GROUP BY stream_id)), r AS (SELECT 'mux' AS stream_id, frame_no * n + place AS frame_no, x // 2 AS x, y // 2 AS y, v FROM p JOIN w USING (stream_id), l WHERE frame_no <= last AND x % 2 = 0 AND y % 2 = 0)")
other("g5_slots", lambda d: joins.slots(_cameras(d), 3), lambda d: d.select("stream_id", "frame_no", F.size("images").alias("n"), F.aggregate(F.col("images")[2]["px"], F.lit(0.0), lambda a, v: a + v).cast("long").alias("third")))
ORACLES["g5_slots"] = f"WITH {_F}, q AS (SELECT CAST(CAST(stream_id AS INTEGER) // 3 AS VARCHAR) AS stream_id, CAST(stream_id AS INTEGER) % 3 AS img, frame_no, list_sum(px) AS total FROM f) SELECT stream_id, frame_no, CAST(count(*) AS INTEGER) AS n, CAST(sum(CASE WHEN img = 2 THEN total ELSE 0 END) AS BIGINT) AS third FROM q GROUP BY stream_id, frame_no HAVING count(*) = 3"


def _meta(d: DataFrame) -> DataFrame:
    return d.where("frame_no % 2 = 0").select("stream_id", "frame_no", F.struct((F.col("frame_no") * 7).alias("ts_ns")).alias("meta"))


other("g6_attach_metadata", lambda d: joins.attach_metadata(d, _meta(d)), lambda d: d.select("stream_id", "frame_no", F.coalesce(F.col("meta.ts_ns"), F.lit(-1)).alias("ts_ns")), "SELECT stream_id, frame_no, CASE WHEN frame_no % 2 = 0 THEN frame_no * 7 ELSE -1 END AS ts_ns FROM f")


def _intervals(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame([(3, 9), (20, 25)], "start_no long, stop_no long")


text("a10_record_between", lambda d: joins.record_between(d, _intervals(d)), "r AS (SELECT * FROM p WHERE frame_no >= 3 AND frame_no < 9 OR frame_no >= 20 AND frame_no < 25)")
other("a11_latest_frame", joins.latest_frame, lambda d: d.select("stream_id", "frame_no", "seq", F.array_join(F.transform("px", lambda v: v.cast("long").cast("string")), ",").alias("px")), "SELECT stream_id, max(frame_no) AS frame_no, count(*) AS seq, array_to_string(arg_max(px, frame_no), ',') AS px FROM f GROUP BY stream_id")


def _holds(d: DataFrame) -> DataFrame:
    return d.sparkSession.createDataFrame([(3, 9), (40, 1 << 62)], "start_no long, stop_no long")


other("a11_latest_frame_held", lambda d: joins.latest_frame(d, _holds(d)), lambda d: d.select("stream_id", "frame_no", "seq", F.array_join(F.transform("px", lambda v: v.cast("long").cast("string")), ",").alias("px")), "SELECT stream_id, max(frame_no) AS frame_no, count(*) AS seq, array_to_string(arg_max(px, frame_no), ',') AS px FROM f WHERE NOT (frame_no >= 3 AND frame_no < 9 OR frame_no >= 40) GROUP BY stream_id")

# --- tiles of 4 x 4 with halos: the same results as of whole frames
text("t1_split_merge", lambda d: tiles.merge(tiles.filtered(tiles.with_halo(tiles.split(d, 4, 4), 3), lambda s: s)), _V.format("v"))
rounded("t2_box", lambda d: tiles.merge(tiles.filtered(tiles.split(d, 4, 4, 1), lambda s: stack.box(s, 3))), _cells("(v + l + q + t + b + tl + tr + bl + br) / 9::DOUBLE"))
text("t3_erode", lambda d: tiles.merge(tiles.filtered(tiles.with_halo(tiles.split(d, 4, 4), 1), lambda s: stack.extreme(s, 3, False))), _minmax("min", "r", "p"))
rounded("t4_gauss", lambda d: tiles.merge(tiles.filtered(tiles.with_halo(tiles.split(d, 4, 4), 1), lambda s: stack.gauss(s, 2.0, 3))), _cells(f"(v + {_W} * (l + q + t + b) + {_W} * {_W} * (tl + tr + bl + br)) / ((1 + 2 * {_W}) * (1 + 2 * {_W}))"))
text("t5_integral", lambda d: tiles.merge(tiles.integral(tiles.split(d, 4, 4)).withColumn("px", F.col("px").cast("array<float>"))), "a AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, frame_no, y ORDER BY x) AS v FROM p), r AS (SELECT stream_id, frame_no, x, y, sum(v) OVER (PARTITION BY stream_id, frame_no, x ORDER BY y) AS v FROM a)")

# --- objects
text("h1_edge_pixels", lambda d: objects.edge_pixels(points.threshold_ge(d, 128), border=True), "m AS (SELECT stream_id, frame_no, x, y, CASE WHEN v >= 128 THEN 1 ELSE 0 END AS v FROM p), " + _NEAR.format(src="m") + ", r AS (SELECT stream_id, frame_no, x, y, CASE WHEN v = 1 AND coalesce(l, 0) * coalesce(q, 0) * coalesce(t, 0) * coalesce(b, 0) = 0 THEN 255 ELSE 0 END AS v FROM n)")
other("h2_components", lambda d: objects.components(points.threshold_ge(d, 150)), lambda d: d.select("stream_id", "frame_no", "l", "r", "t", "b"))
other("t6_components", lambda d: tiles.components(tiles.with_halo(tiles.split(points.threshold_ge(d, 150), 4, 4), 1)), lambda d: d.select("stream_id", "frame_no", "l", "r", "t", "b"))
ORACLES["h2_components"] = f"WITH RECURSIVE {_P}, m AS (SELECT stream_id, frame_no, x, y, CASE WHEN v >= 150 THEN 1 ELSE 0 END AS v FROM p), {_NEAR.format(src='m')}" + """, e AS (SELECT stream_id, frame_no, x, y, y * 8 + x AS id FROM n WHERE v = 1 AND coalesce(l, 0) * coalesce(q, 0) * coalesce(t, 0) * coalesce(b, 0) = 0),
  j AS (SELECT a.stream_id, a.frame_no, a.id AS a, b.id AS b FROM e a JOIN e b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
  reach AS (SELECT stream_id, frame_no, a, b FROM j UNION SELECT k.stream_id, k.frame_no, k.a, j.b FROM reach k JOIN j ON k.stream_id = j.stream_id AND k.frame_no = j.frame_no AND k.b = j.a),
  g AS (SELECT stream_id, frame_no, a AS id, min(b) AS comp FROM reach GROUP BY stream_id, frame_no, a)
  SELECT stream_id, frame_no, CAST(min(x) AS INTEGER) AS l, CAST(max(x) AS INTEGER) AS r, CAST(min(y) AS INTEGER) AS t, CAST(max(y) AS INTEGER) AS b FROM e JOIN g USING (stream_id, frame_no, id) GROUP BY stream_id, frame_no, comp"""
ORACLES["t6_components"] = ORACLES["h2_components"]
rounded("h7_prepare_input", lambda d: points.channel(points.with_planes(points.prepare_input(d, 8, 8)), 0), None)
other("h8_score", lambda d: user.score(d, lambda s: s.reshape(len(s), -1)[:, :2]), lambda d: d.select("stream_id", "frame_no", F.col("scores")[0].alias("a"), F.col("scores")[1].alias("b")), "SELECT stream_id, frame_no, CAST(px[1] AS DOUBLE) AS a, CAST(px[2] AS DOUBLE) AS b FROM f")

# --- user functions
text("k1_apply_frames", lambda d: user.apply_frames(d, lambda f: 255 - f[::-1]), "r AS (SELECT stream_id, frame_no, x, 7 - y AS y, 255 - v AS v FROM p)")
text("k2_apply_pixels", lambda d: user.apply_pixels(d, lambda v: F.floor(v / 255 * (v / 255) * 255 + 0.5)), _V.format("floor(v / 255::DOUBLE * (v / 255::DOUBLE) * 255 + 0.5::DOUBLE)"))
other("k4_frames_to_rows", lambda d: user.frames_to_rows(d, lambda f: [(int(y), float(row.sum())) for y, row in enumerate(f)], "y int, total double"), lambda d: d.select("stream_id", "frame_no", "y", "total"), "SELECT stream_id, frame_no, CAST(y AS INTEGER) AS y, CAST(sum(v) AS DOUBLE) AS total FROM p GROUP BY stream_id, frame_no, y")
text("k5_pipeline", lambda d: user.Pipeline(camera=d).add("mirror", lambda x: geometry.flip(x, True), "camera").add("mask", lambda x: points.threshold_ge(x, 128), "mirror")["mask"], "r AS (SELECT stream_id, frame_no, 7 - x AS x, y, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v FROM p)")


# --- tables of timings, rectangles and detections
def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@_query
def e12_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = _events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("event_id").alias("idx"), F.floor(F.col("value") * 100).cast("long").alias("dur_ns"))
    return histograms.stage_stats(timings)


ORACLES["e12_stage_stats"] = "WITH t AS (SELECT event_type AS stage, event_id AS idx, CAST(floor(value * 100) AS BIGINT) AS dur_ns FROM events), m AS (SELECT stage, max(dur_ns) AS mx FROM t GROUP BY stage) SELECT t.stage, count(*) AS n, min(dur_ns) AS min_ns, CAST(sum(dur_ns) // count(*) AS BIGINT) AS avg_ns, max(dur_ns) AS max_ns, min(CASE WHEN dur_ns = mx THEN idx END) AS max_idx FROM t JOIN m USING (stage) GROUP BY t.stage"


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("frame"), "event_id", F.col("event_type").alias("class_id"), (F.floor(F.col("value")) / 1000).alias("score"))


_DET = "WITH d AS (SELECT user_id AS frame, event_id, event_type AS class_id, floor(value) / 1000 AS score FROM events)"


@_query
def f19_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _detections(spark, sf_dir).groupBy("frame", "class_id").agg(F.max("score").alias("score"))
    return temporal.top_n(one, 2, ["frame"]).select("frame", "class_id", F.round("score", 6).alias("score"), "rank")


ORACLES["f19_top_n"] = _DET + ", o AS (SELECT frame, class_id, max(score) AS score FROM d GROUP BY frame, class_id), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, class_id) AS rank FROM o) SELECT frame, class_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 2"


@_query
def f20_track_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("event_id") % 10).alias("track_id"), F.floor(F.col("event_id") / 10).alias("idx"), F.floor("value").cast("double").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    times = rows.select("track_id", (F.col("idx") * 0.75).alias("t"))
    out = temporal.track_position(rows, 0.5, times)
    return out.select("track_id", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


ORACLES["f20_track_position"] = """WITH s AS (SELECT event_id % 10 AS track_id, event_id // 10 AS idx, CAST(floor(value) AS DOUBLE) AS x, CAST(event_id % 7 AS DOUBLE) AS y FROM events),
  q AS (SELECT track_id, idx * 0.75::DOUBLE AS t, max(idx) OVER (PARTITION BY track_id) AS last FROM s), k AS (SELECT *, least(CAST(floor(t / 0.5::DOUBLE) AS BIGINT), last) AS i FROM q)
  SELECT k.track_id, k.t, round(a.x + (coalesce(b.x, a.x) - a.x) * CASE WHEN b.x IS NULL THEN 0 ELSE k.t / 0.5::DOUBLE - k.i END, 6) AS x, round(a.y + (coalesce(b.y, a.y) - a.y) * CASE WHEN b.x IS NULL THEN 0 ELSE k.t / 0.5::DOUBLE - k.i END, 6) AS y
  FROM k JOIN s a ON a.track_id = k.track_id AND a.idx = k.i LEFT JOIN s b ON b.track_id = k.track_id AND b.idx = k.i + 1"""


@_query
def g7_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = _detections(spark, sf_dir).withColumn("class_id", (F.col("event_id") % 5).cast("int"))
    names = spark.createDataFrame([(0, "car"), (1, "boat"), (2, "bird"), (3, "plane")], "class_id int, name string")
    return joins.label(dets, names).select("event_id", "class_id", "name")


ORACLES["g7_label"] = "SELECT event_id, CAST(event_id % 5 AS INTEGER) AS class_id, CASE event_id % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'boat' WHEN 2 THEN 'bird' WHEN 3 THEN 'plane' END AS name FROM events"


@_query
def h6_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    raw = _detections(spark, sf_dir).select("event_id", (e % 4 - 1).alias("image_id"), "score", *[((e % m) / m).alias(c) for c, m in (("xmin", 7), ("ymin", 11), ("xmax", 13), ("ymax", 17))])
    out = objects.detections(raw, 640, 480, 0.1)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("score", "xmin", "ymin", "xmax", "ymax")])


ORACLES["h6_detections"] = _DET + " SELECT event_id, round(score, 6) AS score, round(event_id % 7 / 7::DOUBLE * 640, 6) AS xmin, round(event_id % 11 / 11::DOUBLE * 480, 6) AS ymin, round(event_id % 13 / 13::DOUBLE * 640, 6) AS xmax, round(event_id % 17 / 17::DOUBLE * 480, 6) AS ymax FROM d WHERE event_id % 4 - 1 <> -1 AND score >= 0.1::DOUBLE"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_partkey") % 100, F.col("l_quantity").cast("int")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("s").alias("stream_id"), F.col("l_orderkey").alias("frame_no"), F.lit(0).alias("img_no"), F.col("l_linenumber").cast("long").alias("rect_id"), k.cast("int").alias("l"), (k + n).cast("int").alias("r"), (F.col("l_suppkey") % 100).cast("int").alias("t"), (F.col("l_suppkey") % 100 + n).cast("int").alias("b"))


_REC = "WITH RECURSIVE x AS (SELECT l_orderkey AS frame_no, CAST(l_linenumber AS BIGINT) AS rect_id, CAST(l_partkey % 100 AS INTEGER) AS l, CAST(l_partkey % 100 + CAST(l_quantity AS INTEGER) AS INTEGER) AS r, CAST(l_suppkey % 100 AS INTEGER) AS t, CAST(l_suppkey % 100 + CAST(l_quantity AS INTEGER) AS INTEGER) AS b FROM lineitem)"
_RECT = ["frame_no", "rect_id", "l", "r", "t", "b"]


@_query
def g8_in_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    roi = spark.createDataFrame([(10, 30, 10, 30), (80, 90, 60, 70)], "l int, r int, t int, b int")
    return joins.in_roi(_rects(spark, sf_dir), roi).select(*_RECT)


ORACLES["g8_in_roi"] = _REC + " SELECT * FROM x WHERE l <= 30 AND r >= 10 AND t <= 30 AND b >= 10 OR l <= 90 AND r >= 80 AND t <= 70 AND b >= 60"


_ROI = "SELECT CAST(user_id % 120 AS INTEGER) AS l, CAST(user_id % 120 + event_id % 9 AS INTEGER) AS r, CAST(event_id % 140 AS INTEGER) AS t, CAST(event_id % 140 + user_id % 7 AS INTEGER) AS b FROM {}"


@_query
def g8_in_many_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of interest for each event; the places where items' boxes and regions lie are the same."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    small = F.expr("l + 3 * t < 60")
    return joins.in_roi(_rects(spark, sf_dir), spark.sql(_ROI.format("{e}"), e=events).where(small)).select(*_RECT)


ORACLES["g8_in_many_rois"] = _REC + f", o AS (SELECT DISTINCT * FROM ({_ROI.format('events')}) WHERE l + 3 * t < 60) SELECT * FROM x WHERE EXISTS (SELECT 1 FROM o WHERE x.l <= o.r AND x.r >= o.l AND x.t <= o.b AND x.b >= o.t)"

_SPANS = "SELECT l_partkey * 3 + l_linenumber AS start_no, l_partkey * 3 + l_linenumber + l_suppkey % 4 AS stop_no FROM {} WHERE l_quantity < 4"


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of streams by type, without pixels."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stream_id"), F.lit(0).alias("img_no"), F.col("event_id").alias("frame_no"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPANS.format("{items}"), items=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@_query
def a10_record_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.record_between(_captures(spark, sf_dir), _spans(spark, sf_dir)).select("stream_id", "frame_no")


ORACLES["a10_record_many"] = f"WITH s AS ({_SPANS.format('lineitem')}) SELECT event_type AS stream_id, event_id AS frame_no FROM events WHERE EXISTS (SELECT 1 FROM s WHERE event_id >= start_no AND event_id < stop_no)"


@_query
def a11_held_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_frame(_captures(spark, sf_dir), _spans(spark, sf_dir)).select("stream_id", "frame_no", "seq")


ORACLES["a11_held_many"] = f"WITH s AS ({_SPANS.format('lineitem')}) SELECT event_type AS stream_id, max(event_id) AS frame_no, count(*) AS seq FROM events WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_id >= start_no AND event_id < stop_no) GROUP BY event_type"


@_query
def h3_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.grow(_rects(spark, sf_dir), 0.1, 128, 128).select(*_RECT)


ORACLES["h3_grow"] = _REC + " SELECT frame_no, rect_id, CAST(greatest(0, l - floor((r - l) * 0.1::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS l, CAST(least(127, r + floor((r - l) * 0.1::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS r, CAST(greatest(0, t - floor((b - t) * 0.1::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS t, CAST(least(127, b + floor((b - t) * 0.1::DOUBLE + 0.5::DOUBLE)) AS INTEGER) AS b FROM x"


@_query
def h4_merge_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.merge_rects(_rects(spark, sf_dir), ["frame_no"]).select("frame_no", "l", "r", "t", "b")


def _merge_rounds(rounds: int) -> str:
    """Each round joins what overlaps, over any number of links; an order has at most seven items, so six rounds end it."""
    near = " AND ".join(f"abs((a.{i} + a.{j}) // 2 - (b.{i} + b.{j}) // 2) <= (a.{j} - a.{i}) // 2 + (b.{j} - b.{i}) // 2" for i, j in (("l", "r"), ("t", "b")))
    steps = "".join(
        f""", n{k} AS (SELECT *, row_number() OVER (PARTITION BY frame_no ORDER BY l, r, t, b) AS id FROM m{k}),
  j{k} AS (SELECT a.frame_no, a.id AS a, b.id AS b FROM n{k} a JOIN n{k} b ON a.frame_no = b.frame_no AND {near}),
  c{k} AS (SELECT frame_no, a, b FROM j{k} UNION SELECT c.frame_no, c.a, j.b FROM c{k} c JOIN j{k} j ON c.frame_no = j.frame_no AND c.b = j.a),
  g{k} AS (SELECT frame_no, a AS id, min(b) AS root FROM c{k} GROUP BY frame_no, a),
  m{k + 1} AS (SELECT frame_no, min(l) AS l, max(r) AS r, min(t) AS t, max(b) AS b FROM n{k} JOIN g{k} USING (frame_no, id) GROUP BY frame_no, root)"""
        for k in range(rounds)
    )
    return f"{_REC}, m0 AS (SELECT frame_no, l, r, t, b FROM x){steps} SELECT * FROM m{rounds}"


ORACLES["h4_merge_rects"] = _merge_rounds(6)


@_query
def h5_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.size_filter(_rects(spark, sf_dir), min_area=50, max_area=900, min_width=5).select(*_RECT)


ORACLES["h5_size_filter"] = _REC + " SELECT * FROM x WHERE (r - l) * (b - t) BETWEEN 50 AND 900 AND r - l >= 5"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, chunk = F.col("event_id"), F.col("event_id") % 3
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("/data/"), F.col("event_type"), F.when(chunk == 0, ".tif").otherwise(F.concat(F.lit("_X"), (chunk + 1).cast("string"), F.lit(".tif")))).alias("path"))
    pages = rows.withColumn("page", F.row_number().over(Window.partitionBy("path").orderBy(e)) - 1)
    return raw_video.stack_pages(pages).select("event_id", "base", "chunk", F.col("frame_no").cast("long").alias("frame_no"))


@_query
def a7_stack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir)


@_query
def a7_pages_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks its type's stack for the page of its number, which for most lies past the end."""
    wanted = _events(spark, sf_dir).select(F.col("event_id").alias("asked"), F.col("event_type").alias("base"), F.col("event_id").cast("long").alias("position"))
    return raw_video.pages_at(_pages(spark, sf_dir), wanted).select("asked", "base", "frame_no", "event_id")


_PAGES = "WITH r AS (SELECT event_id, event_type AS base, event_id % 3 + 1 AS chunk, row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY event_id) - 1 AS page FROM events), n AS (SELECT base, chunk, count(*) AS pages FROM r GROUP BY base, chunk), o AS (SELECT base, chunk, coalesce(sum(pages) OVER (PARTITION BY base ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n) SELECT event_id, r.base, CAST(r.chunk AS INTEGER) AS chunk, CAST(page + off AS BIGINT) AS frame_no FROM r JOIN o ON r.base = o.base AND r.chunk = o.chunk"
ORACLES["a7_stack_pages"] = _PAGES
ORACLES["a7_pages_at"] = f"WITH z AS ({_PAGES}), y AS (SELECT base, max(frame_no) AS last FROM z GROUP BY base) SELECT e.event_id AS asked, z.base, z.frame_no, z.event_id FROM events e JOIN y ON y.base = e.event_type JOIN z ON z.base = y.base AND z.frame_no = least(e.event_id, y.last)"

_DRIFT = "m AS (SELECT stream_id, frame_no, sum(v) / 64::DOUBLE AS m FROM p GROUP BY stream_id, frame_no), t AS (SELECT a.stream_id, a.frame_no, any_value(a.m) AS m, 128::DOUBLE * pow(0.9::DOUBLE, a.frame_no + 1) + sum(b.m * 0.1::DOUBLE * pow(0.9::DOUBLE, a.frame_no - b.frame_no)) AS t FROM m a JOIN m b ON a.stream_id = b.stream_id AND b.frame_no <= a.frame_no GROUP BY a.stream_id, a.frame_no)"
ORACLES["e4_equalise_drift"] = f"WITH {_P}, {_DRIFT}, r AS (SELECT stream_id, frame_no, x, y, CASE WHEN m = 0 THEN v ELSE least(255, floor(v * t / m + 0.5::DOUBLE)) END AS v FROM p JOIN t USING (stream_id, frame_no)) {_TEXT}"
ORACLES["d16_equalise_local_drift"] = f"WITH {_P}, {_DRIFT}, {_NEAR.format(src='p')}, r AS (SELECT stream_id, frame_no, x, y, {_SIDE.format('CASE WHEN v + l + q + n.t + b + tl + tr + bl + br = 0 THEN 0 ELSE v * t.t / ((v + l + q + n.t + b + tl + tr + bl + br) / 9::DOUBLE) END', '0')} AS v FROM n JOIN t USING (stream_id, frame_no)) {_ROUND}"
_BGR = "r AS (SELECT stream_id, frame_no, x, y, v - 104 AS v FROM p)"
ORACLES["h7_prepare_input"] = f"WITH {_P}, {_BGR} {_ROUND}"

#: Histogram equalisation of every frame.
FLAGSHIP = QUERIES["e8_hist_equalise"]
