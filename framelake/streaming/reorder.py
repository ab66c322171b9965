"""Frames of a live stream in order: held until the watermark has passed them, each kept in the state by itself.

The state of an image stream is a map from frame number to frame and one from time to the frames that are due then; a batch writes
its new frames and removes those that go, and nothing else of the state. It needs a state store with several columns
families, so set spark.sql.streaming.stateStore.providerClass to RocksDB's (STORE).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..frames import IMAGE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held(StatefulProcessor):
    """Holds an image stream's frames till they are due. A frame of a number that is held, or has gone, is dropped."""

    def __init__(self, schema: StructType):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "frame_no bigint", "frame binary")
        self.due = handle.getMapState("due", "at bigint", "numbers array<bigint>")
        self.gone = handle.getValueState("gone", "frame_no bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.gone.get()[0] if self.gone.exists() else None
        for batch in rows:
            times = batch["due_ms"].tolist()
            for at, number, row in zip(times, batch["frame_no"].tolist(), batch[self.schema.names].itertuples(index=False, name=None)):
                if (last is not None and number <= last) or self.frames.containsKey((number,)):
                    continue
                self.frames.updateValue((number,), (pickle.dumps(row),))
                numbers = list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
                self.due.updateValue((at,), (numbers + [number],))
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.containsKey((at,)):
            numbers = sorted(self.due.getValue((at,))[0])
            made = []
            for number in numbers:
                made.append(pickle.loads(bytes(self.frames.getValue((number,))[0])))
                self.frames.removeKey((number,))
            self.due.removeKey((at,))
            last = self.gone.get()[0] if self.gone.exists() else numbers[-1]
            self.gone.update((max(last, numbers[-1]),))
            yield pd.DataFrame(made, columns=self.schema.names)

    def close(self) -> None:
        pass


def reordered(df: DataFrame, delay: str) -> DataFrame:
    """df in order: a frame comes out once the watermark, the newest ts less the delay, has passed its ts.

    Arrival may be in any order inside the delay; repeated frames come once; frames later than the delay are dropped.
    ts has to rise with frame_no and must not be null.
    """
    rows = df.withWatermark("ts", delay).withColumn("due_ms", F.unix_millis("ts"))
    return rows.groupBy(*IMAGE).transformWithStateInPandas(Held(df.schema), df.schema, "Append", "EventTime", eventTimeColumnName="ts")
