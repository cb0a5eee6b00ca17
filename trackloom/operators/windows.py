"""Overlapping frame windows and the stitching of what they yield."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULTS


def _check(window: int, overlap: int) -> int:
    if not 0 < overlap < window:
        raise ValueError("0 < overlap < window is required")
    return window - overlap


def frame_windows(clips: DataFrame, window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap) -> DataFrame:
    """(clip_id, n_frames) to (clip_id, window_id, start, end): the last window is clipped; none for n_frames <= overlap."""
    step = _check(window, overlap)
    n = F.greatest(F.lit(0), F.ceil((F.col("n_frames") - overlap) / step)).cast("int")
    w = clips.select("clip_id", "n_frames", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("window_id"))
    start = F.col("window_id") * step
    return w.select("clip_id", "window_id", start.alias("start"), F.least(start + window, "n_frames").cast("int").alias("end"))


def windows_of_frames(frames: DataFrame, n_frames: str = "n_frames", window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap) -> DataFrame:
    """Each frame with every window that holds it: arithmetic on its index, no join; one or two windows at small overlaps."""
    step = _check(window, overlap)
    last = F.greatest(F.lit(0), F.ceil((F.col(n_frames) - overlap) / step)).cast("long") - 1
    low = F.greatest(F.lit(0), F.floor((F.col("frame_idx") - window) / step) + 1).cast("long")
    high = F.least(F.floor(F.col("frame_idx") / step).cast("long"), last)
    return frames.withColumn("window_id", F.explode(F.when(low <= high, F.sequence(low, high))))


def stitch(chunks: DataFrame) -> DataFrame:
    """(window_id, clip_id, frame_idx, track_id, ...): of rows that share clip, frame and track, the latest window's stays."""
    w = Window.partitionBy("clip_id", "track_id", "frame_idx").orderBy(F.desc("window_id"))
    return chunks.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def advance(frames, points, tracker, window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap, closed: bool = True):
    """Windows of a clip's ``frames`` (pandas, in order) in turn: (what they yield, frames that are left, start points of the next window).

    A window runs once it is known whether it is the last: when a frame stands behind it, or when the clip is ``closed``. Each
    starts at the points where the one before left its first shared frame, and yields what lies before the next one's first frame.
    """
    step, out = _check(window, overlap), []
    while len(frames) > window or (closed and len(frames) > overlap):
        got = tracker(frames.iloc[:window], points)
        if len(frames) <= window:
            return [*out, got], frames.iloc[:0], None
        turn = frames["frame_idx"].iloc[step]
        at = got["frame_idx"].to_numpy()
        points = got[at == turn] if (at == turn).any() else None
        out.append(got[at < turn])
        frames = frames.iloc[step:]
    return out, frames, points


def stitch_clip(frames: DataFrame, tracker, schema: str, window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap) -> DataFrame:
    """Windows of a clip in turn, each started at the points where the one before left its first shared frame.

    A window needs the tracker's output on the one before, so a clip is in one partition, in order, and clips run in parallel.
    Many clips come in one batch of rows, and a clip may go on over several: only the frames of its next window wait. ``tracker`` is
    called with a window's frames and the start points (None for the first), and returns rows with frame_idx. Streams: ``streaming.stitching``.
    """
    _check(window, overlap)

    def run(batches):
        import numpy as np
        import pandas as pd

        clip, left, points = None, None, None
        for batch in batches:
            out, keys = [], batch.column("clip_id")
            plain = keys.fill_null(0).to_numpy(zero_copy_only=False)
            turns = (plain[1:] != plain[:-1]) | (np.diff(keys.is_null().to_numpy(zero_copy_only=False).astype(np.int8)) != 0)
            ends = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
            whole = None if any(c.null_count for c in batch.columns) else batch.to_pandas()  # a null changes a column's kind, for its own clip only
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a).to_pandas() if whole is None else whole.iloc[a:b]
                key = keys[a].as_py()
                if left is not None and key != clip:
                    out += advance(left, points, tracker, window, overlap)[0]
                    left, points = None, None
                clip = key
                got, left, points = advance(part if left is None else pd.concat([left, part]), points, tracker, window, overlap, False)
                out += got
            if out:
                yield from _arrow(pd.concat(out))
        if left is not None and (out := advance(left, points, tracker, window, overlap)[0]):
            yield from _arrow(pd.concat(out))

    def _arrow(rows):
        import pyarrow as pa

        return pa.Table.from_pandas(rows, wanted, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))
    ordered = frames.repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx")
    return ordered.mapInArrow(run, schema)
