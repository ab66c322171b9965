"""The user's own functions over frames, and named chains of operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..frames import FORMATS, with_px
from .vector import per_stack, small_batches


def apply_frames(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], out_fmt: str | None = None) -> DataFrame:
    """fn: one frame (height, width, channels) to another, which may differ in size and, with out_fmt, in format."""
    return per_stack(df, lambda s: np.stack([np.asarray(fn(f), float) for f in s]), out_fmt)


def apply_pixels(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """fn: a column function of one component, which stays inside generated code."""
    return with_px(df, F.transform("px", lambda v: fn(v.cast("double"))))


def consume(df: DataFrame, fn: Callable[[Iterator[Row]], None], checkpoint: str | None = None, **trigger) -> StreamingQuery | None:
    """fn gets the rows of each partition of a table, or of each micro-batch of a stream.

    A stream needs a checkpoint folder and gives its query; trigger as in writeStream.trigger. Batches come in order, each at
    least once: after a failure the last may come again, so what fn stores should be keyed by frame.
    """
    if not df.isStreaming:
        return df.foreachPartition(fn)
    if not checkpoint:
        raise ValueError("a stream is consumed with a checkpoint folder")
    writer = df.writeStream.foreachBatch(lambda batch, _: batch.foreachPartition(fn)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def frames_to_rows(df: DataFrame, fn: Callable[[np.ndarray], list[tuple]], schema: str, keys: tuple[str, ...] = ("stream_id", "frame_no", "img_no")) -> DataFrame:
    """Any number of rows for each frame: fn's tuples have the columns of schema, the keys come first."""
    small_batches(df)
    added = df.sparkSession.createDataFrame([], schema).schema
    whole = df.select(*keys).schema
    for f in added:
        whole = whole.add(f)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                frame = np.asarray(r.px, float).reshape(r.height, r.width, FORMATS[r.pix_fmt].channels)
                rows += [(*(getattr(r, k) for k in keys), *x) for x in fn(frame)]
            yield pd.DataFrame(rows, columns=whole.names)

    return df.mapInPandas(run, whole)


def score(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], name: str = "scores") -> DataFrame:
    """df with name: predict maps a stack of equal-sized frames to one row of numbers each (any model, loaded by predict)."""
    small_batches(df)
    schema = df.withColumn(name, F.lit(None).cast("array<double>")).schema

    def run(batches):
        import pyarrow as pa

        from .vector import shapes, stacked

        for batch in batches:
            out: list = [None] * batch.num_rows
            for shape, rows in shapes(batch).items():
                for i, row in zip(rows, np.asarray(predict(stacked(batch.column("px"), rows, shape)), float)):
                    out[i] = row.tolist()
            yield batch.append_column(name, pa.array(out, pa.list_(pa.float64())))

    return df.mapInArrow(run, schema)


class Pipeline:
    """Named operators over named results; nothing runs before a result is written."""

    def __init__(self, **sources: DataFrame):
        self.results = dict(sources)

    def add(self, name: str, op: Callable[[DataFrame], DataFrame], source: str) -> Pipeline:
        if name in self.results:
            raise ValueError(f"{name} is taken")
        self.results[name] = self.results[source].transform(op)
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.results[name]
