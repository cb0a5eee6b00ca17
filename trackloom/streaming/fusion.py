"""Frames and depth maps as two streams, met by frame and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import geometry as G
from ..operators.projection import centred, depth_in_map, position
from ..schemas import Intrinsics
from ..udf import OcrConfig, detect_text


def annotate_streams(
    frames: DataFrame, depth: DataFrame, detector: Callable[[bytes], list[dict]], k: Intrinsics, height: int, width: int, min_confidence: float = 0.0, depth_scale: float = 1.0, frame_skip: int = 1, ocr: OcrConfig | None = None,
    late: str = "10 seconds", apart: str = "1 second", unmatched: bool = False,
) -> DataFrame:
    """Streams of frames (frame_idx, ts, content) and of depth maps (frame_idx, ts, height, width, depth) to 3-D text annotations.

    A stream-stream join: a frame and a map of one number belong together if their times differ by ``apart`` at most, whichever comes
    first. The detector runs before the join, so what waits for its map is text, not images. Rows that are ``late`` behind
    what has been seen of both streams are left out, and what has waited beyond any possible partner is dropped from the state, so
    the state holds the rows of some ``late`` and ``apart`` of time, however long the streams are. Two maps of a frame annotate it
    twice. Detections whose map never came give nothing; with ``unmatched`` they come with a null position, once no map
    can come any more. Otherwise as ``attach_text``; on tables it gives the same at once.
    """
    found = detect_text(frames, detector, frame_skip=frame_skip, config=ocr, keep=("ts",)).withColumn("confidence", F.col("conf").cast("double"))
    found = centred(found, height, width, min_confidence).withWatermark("ts", late)
    maps = depth.select(F.col("frame_idx").alias("__frame"), F.col("ts").alias("__ts"), F.col("height").alias("__h"), F.col("width").alias("__w"), F.col("depth").alias("__depth")).withWatermark("__ts", late)
    near = F.expr(f"frame_idx = __frame and __ts >= ts - interval {apart} and __ts <= ts + interval {apart}")
    met = found.join(maps, near, "left_outer" if unmatched else "inner").withColumn("z", depth_in_map().cast("double") * F.lit(float(depth_scale)))
    placed = F.when(F.col("__ts").isNotNull(), position(k)).alias("position_3d")
    return met.where(F.col("__ts").isNull() | G.valid_depth("z")).select("frame_idx", "ts", "text", placed, "confidence", F.struct("u", "v").alias("pixel_uv"))


def to_epochs(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now, each micro-batch to a folder of its own; one that is repeated replaces its folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
