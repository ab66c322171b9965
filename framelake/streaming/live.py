"""Live streams. Point, geometry and neighbourhood operators take streaming DataFrames as they are.

Recursive filters hold state by image stream, or with tile > 0 by runs of that many values of an image. Then a result row
is one run, with its number in the column `tile`, and whole() puts the rows of a micro-batch together again, in
foreachBatch; all runs of a frame come in one micro-batch. Order is by frame_no: frames that the state has passed, and
repeated ones, are dropped. So each filter gives what its batch form gives for the frames that it takes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import IMAGE, KEY, with_px
from ..operators import histograms, joins, registration, temporal

#: What a filter holds for one image stream or run: some arrays of one length.
Held = list[np.ndarray] | None


def newest(batch: DataFrame) -> DataFrame:
    """Of each image stream only the newest frame of a micro-batch."""
    order = Window.partitionBy("stream_id", "img_no").orderBy(F.col("frame_no").desc())
    return batch.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def keep_latest(df: DataFrame, sink: Callable[[DataFrame, int], None]):
    """A stream writer that hands the sink the newest frames only: what queued up behind them is dropped."""
    return df.writeStream.foreachBatch(lambda batch, number: sink(newest(batch), number))


def ordered(df: DataFrame, delay: str) -> DataFrame:
    """Repeated and late frames dropped within the watermark; stateful operators below sort what a batch brings."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEY)


def in_tiles(df: DataFrame, values: int, *columns: str) -> DataFrame:
    """A row for each run of `values` values of the columns (arrays as long as px), numbered by `tile`."""
    last = F.ceil(F.greatest(F.lit(1), F.size("px")) / values).cast("int") - 1
    spread = df.withColumn("tile", F.explode(F.sequence(F.lit(0), last)))
    return spread.withColumns({c: F.slice(c, F.col("tile") * values + 1, F.lit(values)) for c in columns})


def whole(batch: DataFrame, *columns: str) -> DataFrame:
    """Frames of a micro-batch from their runs; columns: the arrays that were cut, px if none are named."""
    columns = columns or ("px",)
    rest = [c for c in batch.columns if c not in (*KEY, "tile", *columns)]
    runs = batch.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tile", *columns))).alias("runs"), F.min_by(F.struct(*rest), "tile").alias("one"))
    made = {c: F.flatten(f"runs.{c}") for c in columns} | {c: F.col(f"one.{c}") for c in rest}
    return runs.select([made.get(c, F.col(c)).alias(c) for c in batch.columns if c != "tile"])


def _stateful(df: DataFrame, by: list[str], unique: list[str], added: dict[str, str], take: Callable[[pd.DataFrame, Held], tuple[Held, dict[str, list]]]) -> DataFrame:
    """df with the columns `added`, which take() makes of a group's new rows in order and of what it held."""
    schema = df.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items()}).schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, held = -1, None
        if state.exists:
            last, packed, n = state.get
            held = list(np.frombuffer(packed, "<f8").reshape(n, -1))
        rows = pd.concat(list(frames)).sort_values("frame_no")
        rows = rows[rows["frame_no"] > last].drop_duplicates(unique)
        if len(rows):
            held, columns = take(rows, held)
            state.update((int(rows["frame_no"].iloc[-1]), np.stack(held).astype("<f8").tobytes(), len(held)))
            yield rows.assign(**{c: pd.Series(v, index=rows.index) for c, v in columns.items()})

    return df.groupBy(*by).applyInPandasWithState(run, schema, "last long, held binary, arrays int", "append", "NoTimeout")


def _recursive(df: DataFrame, step: Callable[..., tuple[list[np.ndarray], list[np.ndarray]]], outputs: list[str], inputs: tuple[str, ...] = ("px",), tile: int = 0) -> DataFrame:
    """df with array columns: step(held, frame_no, *inputs) gives what to hold and the outputs; held is None at first."""
    rows = in_tiles(df, tile, *dict.fromkeys(("px", *inputs))) if tile else df
    by = [*IMAGE, "tile"] if tile else IMAGE

    def take(rows: pd.DataFrame, held: Held) -> tuple[Held, dict[str, list]]:
        found: list[list] = [[] for _ in outputs]
        for number, *values in zip(rows["frame_no"], *(rows[c] for c in inputs)):
            held, made = step(held, number, *(np.asarray(v, float) for v in values))
            for column, x in zip(found, made, strict=True):
                column.append(x.tolist())
        return held, dict(zip(outputs, found))

    return _stateful(rows, by, ["frame_no"], dict.fromkeys(outputs, "array<double>"), take)


def stream_background(df: DataFrame, a: float = 0.01, tile: int = 0) -> DataFrame:
    """bg_mean and bg_var as in operators.temporal.background_model, frame by frame."""

    def step(held, number, v):
        if held is None:
            held = [v, np.full(v.shape, 100.0)]
        else:
            mean = v * a + held[0] * (1 - a)
            held = [mean, (np.floor(v) - np.floor(mean)) ** 2 * a + held[1] * (1 - a)]
        return held, held

    return _recursive(df, step, ["bg_mean", "bg_var"], tile=tile)


def stream_average(df: DataFrame, b: int, tile: int = 0) -> DataFrame:
    """Moving average over 2**b frames, zeros before the first; the state holds the last 2**b frames."""
    n = 1 << b

    def step(held, number, v):
        held = [v, *(held or [np.zeros(v.shape)] * n)[: n - 1]]
        return held, [sum(held) / n]

    moved = _recursive(df, step, ["__x"], tile=tile)
    return with_px(moved, F.col("__x")).drop("__x")


def stream_average_adaptive(df: DataFrame, control: float, k: int | None = None, tile: int = 0) -> DataFrame:
    """temporal.average_adaptive: frames are blurred where they are whole, the rate needs the run alone."""

    def step(held, number, v, blur):
        if held is not None:
            t = np.clip(np.abs(blur - held[1]) * control, 0.1, 1.0)
            v = v * t + held[0] * (1 - t)
        return [v, blur], [v]

    moved = _recursive(temporal.with_blur(df, k), step, ["__x"], ("px", "blur"), tile)
    return with_px(moved, F.col("__x")).drop("__x", "blur")


def stream_equalise_drift(df: DataFrame, t0: float, speed: float) -> DataFrame:
    """histograms.equalise_drift; the state is one number an image stream."""

    def step(held, number, mean):
        target = (t0 if held is None else held[0]) * (1 - speed) + mean * speed
        return [target], [target]

    rows = df.withColumn("_mean", histograms.frame_mean(df)).withColumn("__m", F.array("_mean"))
    return histograms.to_drifting_target(_recursive(rows, step, ["_t"], ("__m",))).drop("__m")


def stream_persistent(cells: DataFrame, n: int = 2) -> DataFrame:
    """temporal.persistent; the state holds the runs of one row of cells."""

    def take(rows: pd.DataFrame, held: Held) -> tuple[Held, dict[str, list]]:
        run = np.zeros(max(int(rows["cell_x"].max()) + 1, 0 if held is None else len(held[0])))
        if held is not None:
            run[: len(held[0])] = held[0]
        runs = []
        for x, marked in zip(rows["cell_x"], rows["marked"]):
            run[x] = run[x] + 1 if marked else 0
            runs.append(int(run[x]))
        return [run], {"run": runs, "detected": [r > n for r in runs]}

    return _stateful(cells, [*IMAGE, "cell_y"], ["frame_no", "cell_x"], {"run": "bigint", "detected": "boolean"}, take)


def stream_accumulate_shift(hvect: DataFrame, bx: float = 1.0, by: float = 1.0) -> DataFrame:
    """registration.accumulate_shift."""
    burn = np.array([bx, by])

    def step(held, number, h):
        moved = np.zeros(2) if held is None else held[0]
        moved = (moved + h) * burn if number > 2 else moved * burn
        return [moved], [moved]

    found = _recursive(hvect.withColumn("__h", F.array("hx", "hy")), step, ["__c"], ("__h",))
    return found.select(*hvect.columns, F.col("__c")[0].alias("cum_hx"), F.col("__c")[1].alias("cum_hy"))


def stream_reference(df: DataFrame, longevity: float = 0.95, tile: int = 0) -> DataFrame:
    """df with ref, the running mean of the frames before that dewarp draws a frame towards."""

    def step(held, number, v):
        before = v if held is None else held[1]
        keep = 0.0 if number < 3 else longevity
        ref = before * (1 - keep) + (0.0 if held is None else held[0] * keep)
        return [ref, v], [ref]

    return _recursive(df, step, ["ref"], tile=tile)


def stream_dewarp(df: DataFrame, longevity: float = 0.95, border: float = 0.0) -> DataFrame:
    """registration.dewarp; with runs, call stream_reference, whole() and registration.to_reference."""
    return registration.to_reference(stream_reference(df, longevity), border).drop("ref")


def _matched(a: DataFrame, b: DataFrame, delay: str) -> DataFrame:
    """Frames of two live streams by number: an inner join bounded by watermarks on ts; other formats fail the query."""
    left = a.withWatermark("ts", delay)
    right = b.withWatermark("ts", delay).select(F.col("frame_no").alias("no_b"), F.col("img_no").alias("img_b"), F.col("ts").alias("ts_b"), F.col("px").alias("px_b"), F.struct("pix_fmt", "width", "height").alias("shape_b"))
    on = F.expr(f"frame_no = no_b AND img_no = img_b AND ts_b BETWEEN ts - INTERVAL {delay} AND ts + INTERVAL {delay}")
    return joins.of_one_format(left.join(right, on))


def diff_streams(a: DataFrame, b: DataFrame, scale: float, delay: str) -> DataFrame:
    """|(a - b) * scale| of two live streams."""
    return joins.difference(_matched(a, b, delay), scale).select(*a.columns)


def gain_streams(a: DataFrame, mask: DataFrame, gain: float, delay: str) -> DataFrame:
    """(a - mask) * gain + mask of two live streams."""
    return joins.gained(_matched(a, mask, delay), gain).select(*a.columns)
