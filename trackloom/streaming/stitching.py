"""Stitching of clips that arrive as a stream: the tracker's state is carried from micro-batch to micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import _check, advance
from ..schemas import DEFAULTS

#: The time of a frame without one: no watermark passes it, so it waits for the clip's end.
NEVER = np.iinfo(np.int64).max
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """A query that is started within keeps its state in RocksDB, which state of this kind asks for; others don't."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _packed(rows: pd.DataFrame | None) -> bytes:
    if rows is None:
        return b""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame | None:
    return pa.ipc.open_stream(raw).read_pandas() if raw else None


class Stitcher(StatefulProcessor):
    """The state of a clip: frames that no window has passed yet, where the next window starts, and when the clip closes."""

    def __init__(self, tracker: Callable, window: int, overlap: int, gap_ms: int):
        self.tracker, self.window, self.overlap, self.gap_ms = tracker, window, overlap, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clip", "frames binary, points binary, closes long")

    def _run(self, frames: pd.DataFrame, points: pd.DataFrame | None, watermark: int, closed: bool):
        """Windows over the frames whose time has passed, in order; the others wait."""
        if closed:
            return advance(frames.sort_values("frame_idx"), points, self.tracker, self.window, self.overlap, True)
        passed = frames["__ms"].to_numpy() <= watermark
        if not passed.any():
            return [], frames, points
        out, left, points = advance(frames[passed].sort_values("frame_idx"), points, self.tracker, self.window, self.overlap, False)
        return out, left if passed.all() else pd.concat([left, frames[~passed]]), points

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        ts = new["ts"].to_numpy()
        ms = ts.astype("datetime64[ms]").astype(np.int64)
        new["__ms"] = np.where(np.isnat(ts), NEVER, ms)
        points, before, watermark = None, None, timerValues.getCurrentWatermarkInMs()
        if (known := self.state.get()) is not None:
            held, start, before = known
            new, points = pd.concat([_unpacked(bytes(held)), new]), _unpacked(bytes(start))
        closes = max(before or 0, int(ms[~np.isnat(ts)].max(initial=watermark)) + self.gap_ms)
        out, left, points = self._run(new, points, watermark, False)
        self.state.update((_packed(left), _packed(points), closes))
        if closes != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(closes)
        if out:
            yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, start, _ = self.state.get()
        out, _, _ = self._run(_unpacked(bytes(held)), _unpacked(bytes(start)), timerValues.getCurrentWatermarkInMs(), True)
        self.state.clear()
        if out:
            yield pd.concat(out)

    def close(self) -> None:
        pass


def stitch_stream(frames: DataFrame, tracker: Callable, schema: str, late: str = "10 seconds", gap_ms: int = 60_000, window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap) -> DataFrame:
    """A stream of frames (clip_id, frame_idx, ts, ...) through ``tracker``, as ``stitch_clip`` does it for whole clips.

    Frames may come in any order and be cut into micro-batches anywhere: a frame waits until the watermark, ``late`` behind the
    newest, has passed it; a window runs when a frame behind it has; the points at its first shared frame stay in the state for the
    next one. A clip without a frame for ``gap_ms`` of event time is closed by a timer, which runs its last window and drops its state;
    frames after that begin a clip anew. Frames behind the watermark are left out. A clip's state is a window, its points
    and the frames of ``late`` of time. Start the query within ``rocksdb_state``.
    """
    _check(window, overlap)
    keyed = frames.withWatermark("ts", late).groupBy("clip_id")
    return keyed.transformWithStateInPandas(Stitcher(tracker, window, overlap, gap_ms), schema, "Append", "EventTime")
