"""Frames through NumPy: Arrow batches of a few frames become stacks of equal shape; keys and metadata pass through."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..frames import FORMATS

#: Frames and bytes in one Arrow batch at most: a 1080p float frame is 25 MB.
BATCH_FRAMES, BATCH_BYTES = 256, 64 << 20


def small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_FRAMES))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def switchable(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """op with a further parameter: enabled=False gives the input as it is."""

    @wraps(op)
    def run(df: DataFrame, *args, enabled: bool = True, **named) -> DataFrame:
        return op(df, *args, **named) if enabled else df

    return run


def utc(table: pa.Table) -> pa.Table:
    """Times in UTC, as Spark wants the results of grouped functions; in a session of another zone it gives them in that."""
    for i, field in enumerate(table.schema):
        if pa.types.is_timestamp(field.type) and field.type.tz:
            table = table.set_column(i, field.name, table.column(i).cast(pa.timestamp("us", "UTC")))
    return table


def shapes(batch: pa.RecordBatch | pa.Table) -> dict[tuple[int, int, int], np.ndarray]:
    """Row numbers by (height, width, channels)."""
    width, height = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy()) for c in ("width", "height"))
    n = np.array([FORMATS[f].channels for f in batch.column("pix_fmt").to_pylist()], int)
    found: dict[tuple[int, int, int], list[int]] = {}
    for i, key in enumerate(zip(height.tolist(), width.tolist(), n.tolist())):
        found.setdefault(key, []).append(i)
    return {key: np.array(rows) for key, rows in found.items()}


def stacked(column: pa.Array, rows: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), *shape)


def px_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<float> column of flattened frames; NaN becomes null."""
    at = np.concatenate([[0], np.cumsum([a.size for a in arrays])]).astype(np.int32)
    flat = np.concatenate([a.ravel() for a in arrays]).astype(np.float32) if arrays else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, from_pandas=True))


def per_stack(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], pix_fmt: str | None = None, extra: str | None = None) -> DataFrame:
    """df with the pixels fn makes of stacks (frames, height, width, channels); fn may change the size.

    extra: name of a double column if fn returns (stack, one value a frame). Stateless per frame: works on streams too.
    """
    small_batches(df)
    schema = df.schema if not extra else df.withColumns({extra: df["width"].cast("double")}).schema

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            size, values = np.zeros((batch.num_rows, 2), np.int32), np.zeros(batch.num_rows)
            for shape, rows in shapes(batch).items():
                made = fn(stacked(batch.column("px"), rows, shape))
                if extra:
                    made, values[rows] = made
                for k, i in enumerate(rows):
                    out[i] = made[k]
                size[rows] = made.shape[2], made.shape[1]
            new = {"px": px_lists(out), "width": pa.array(size[:, 0]), "height": pa.array(size[:, 1])}
            if pix_fmt:
                new["pix_fmt"] = pa.array([pix_fmt] * batch.num_rows, pa.string())
            columns = [new.get(name, batch.column(name)) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(values)] if extra else []), names=schema.names)

    return df.mapInArrow(run, schema)
