"""Per-track operators over a tracking table (track_id, frame_idx, x, y, z, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import DEFAULTS


def track_summary(tracks: DataFrame, track_id: int | None = None) -> DataFrame:
    """First and last frame, rows, mean depth and confidence, and the length of the (x, y) path; all tracks or one.

    The step to the row before comes from one window by track and frame, whose shuffle the aggregation reuses.
    """
    t = tracks if track_id is None else tracks.where(F.col("track_id") == track_id)
    w = Window.partitionBy("track_id").orderBy("frame_idx")
    dx, dy = (F.col(a).cast("double") - F.lag(F.col(a).cast("double")).over(w) for a in "xy")
    return (
        t.withColumn("step", F.sqrt(dx * dx + dy * dy))
        .groupBy("track_id")
        .agg(
            F.min("frame_idx").alias("first_frame"),
            F.max("frame_idx").alias("last_frame"),
            F.count("*").alias("num_frames"),
            F.avg(F.col("z").cast("double")).alias("mean_depth"),
            F.avg(F.col("confidence").cast("double")).alias("mean_confidence"),
            F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"),
        )
    )


def track_locations(tracks: DataFrame, track_id: int, frame_idx: int | None = None) -> DataFrame:
    """Rows of one track, by frame; of one frame, if given."""
    t = tracks.where(F.col("track_id") == track_id)
    return (t if frame_idx is None else t.where(F.col("frame_idx") == frame_idx)).select("track_id", "frame_idx", "x", "y", "z", "confidence").orderBy("frame_idx")


def track_answer(tracks: DataFrame, wanted: DataFrame, frame_idx: int | None = None) -> DataFrame:
    """For each ``wanted`` track_id: found, num_frames and its locations in frame order.

    A known track without the asked frame is found and has no locations; num_frames is null for an unknown one.
    """
    loc = F.struct("frame_idx", "x", "y", "z", "confidence")
    shown = F.when(F.lit(frame_idx is None) | (F.col("frame_idx") == F.lit(frame_idx or 0)), loc)
    got = tracks.join(wanted.select("track_id").distinct(), "track_id", "left_semi").groupBy("track_id").agg(F.count(shown).alias("n"), F.array_sort(F.collect_list(shown)).alias("locations"))
    out = wanted.select("track_id").join(got, "track_id", "left")
    return out.select("track_id", F.col("n").isNotNull().alias("found"), F.col("n").alias("num_frames"), F.coalesce("locations", F.array()).alias("locations"))


def of_class(tracks: DataFrame, class_name: str, frame_idx: int | None = None) -> DataFrame:
    t = tracks.where(F.col("class_name") == class_name)
    return t if frame_idx is None else t.where(F.col("frame_idx") == frame_idx)


def _step() -> Column:
    r, g, b = G.track_color("point_id")
    xyz = [F.col(a).cast("double").alias(a.lower()) for a in "XYZ"]
    return F.struct(F.col("frame_id").alias("f"), *xyz, r.alias("r"), g.alias("g"), b.alias("b"))


def trajectories(points: DataFrame) -> DataFrame:
    """(frame_id, point_id, X, Y, Z) to one row per point: id and its path in frame order, with the track's colour."""
    return points.groupBy(F.col("point_id").alias("id")).agg(F.array_sort(F.collect_list(_step())).alias("path"))


def trajectory_parts(points: DataFrame, fps: int = DEFAULTS.fps, frames: int = 10_000) -> DataFrame:
    """(fps, id, part, path): paths in parts of so many frame numbers, so that no row holds more of a path than that."""
    part = F.expr(f"frame_id div {frames}").alias("part")
    own = points.groupBy(F.col("point_id").alias("id"), part).agg(F.array_sort(F.collect_list(_step())).alias("path"))
    return own.select(F.lit(fps).alias("fps"), "id", "part", "path")


def trajectory_document(points: DataFrame, fps: int = DEFAULTS.fps) -> DataFrame:
    """The nested document {fps, tracks: [{id, path}]} as one JSON string: an export for a viewer of one clip."""
    doc = trajectories(points).agg(F.array_sort(F.collect_list(F.struct("id", "path"))).alias("tracks"))
    return doc.select(F.to_json(F.struct(F.lit(fps).alias("fps"), "tracks")).alias("value"))


def playback_position(paths: DataFrame, times: DataFrame, fps: int = DEFAULTS.fps) -> DataFrame:
    """Where each path is at its playback times: (id, path) and (id, seconds)."""
    at = paths.join(times, "id").withColumn("frame", G.frame_at("seconds", fps, F.size("path")))
    return at.withColumn("p", F.get("path", F.col("frame").cast("int"))).select("id", "seconds", "frame", "p.x", "p.y", "p.z", *[F.coalesce(f"p.{c}", F.lit(1.0)).alias(c) for c in "rgb"])


def group_by_track(rows: DataFrame, placeholder_dim: int = DEFAULTS.placeholder_dim) -> DataFrame:
    """(track_id, row_idx, embedding) to one row per track with its vectors in row order; missing ones are zeros."""
    v = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), placeholder_dim))
    return rows.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", v.alias("v")))), lambda s: s["v"]).alias("embeddings"))
