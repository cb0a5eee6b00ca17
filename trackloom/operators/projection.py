"""Projection of tracked pixels to 3-D through depth, and 3-D text annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import ANNOTATION_3D, DEFAULTS, Intrinsics
from .ranking import ranked


def depth_maps(depth: DataFrame) -> DataFrame:
    """(frame_idx, v, u, z), every pixel once, to one row per frame: (frame_idx, height, width, depth), depths row by row."""
    rows = F.array_sort(F.collect_list(F.struct("v", "u", "z")))
    return depth.groupBy("frame_idx").agg((F.max("v") + 1).alias("height"), (F.max("u") + 1).alias("width"), F.transform(rows, lambda p: p["z"]).alias("depth"))


def at_pixels(points: DataFrame, depth: DataFrame) -> DataFrame:
    """``points`` (frame_idx, v, u, ...) with z, their pixel's depth; points of frames or pixels without one drop out.

    ``depth`` has a row for each frame, (frame_idx, height, width, depth), or one for each pixel, (frame_idx, v, u, z). With a
    row for each frame the join is on the frame alone, so a map moves as one array and none of its pixels is a row.
    """
    if "depth" not in depth.columns:
        return points.join(depth.select("frame_idx", "v", "u", "z"), ["frame_idx", "v", "u"])
    maps = depth.select("frame_idx", F.col("height").alias("__h"), F.col("width").alias("__w"), F.col("depth").alias("__depth"))
    return points.join(maps, "frame_idx").withColumn("z", depth_in_map()).where("v >= 0 and v < __h and u >= 0 and u < __w").drop("__h", "__w", "__depth")


def depth_in_map() -> Column:
    """The depth at pixel (v, u) of a map (__h, __w, __depth); null outside."""
    inside = (F.col("v") >= 0) & (F.col("v") < F.col("__h")) & (F.col("u") >= 0) & (F.col("u") < F.col("__w"))
    return F.when(inside, F.get("__depth", F.col("v") * F.col("__w") + F.col("u")))


def require_depth(depth: DataFrame) -> DataFrame:
    """``depth`` (a row for each frame) if it has any row and all its maps hold height times width values, else ValueError."""
    bad = (F.col("depth").isNull()) | (F.coalesce(F.col("height") * F.col("width"), F.lit(0)) <= 0) | (F.size("depth") != F.col("height") * F.col("width"))
    n, wrong = depth.agg(F.count("*"), F.count_if(F.coalesce(bad, F.lit(True)))).first()
    if not n or wrong:
        raise ValueError(f"depth maps are not valid: {n} in all, {wrong} empty or not of their height times width")
    return depth


def project_to_3d(tracks: DataFrame, depth: DataFrame, height: int, width: int, k: Intrinsics | None = None, mask_invalid: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(frame_idx, track_id, x, y) with depths (see ``at_pixels``) to (frame_id, point_id, X, Y, Z, valid) and columns to ``keep``.

    One equi-join for all frames; frames without depth drop out. Points are kept and flagged where
    their depth is not finite or not positive; points without a pixel (NaN) drop out. The unrounded pixel is projected.
    """
    k = k or Intrinsics.of_size(height, width)
    at = tracks.select("frame_idx", F.col("track_id").alias("point_id"), "x", "y", G.pixel_index("y", height).alias("v"), G.pixel_index("x", width).alias("u"), *keep)
    p = at_pixels(at, depth).withColumn("p", G.back_project("x", "y", "z", k))
    valid = G.valid_depth("z") if mask_invalid else F.lit(True)
    return p.select(F.col("frame_idx").alias("frame_id"), "point_id", "p.X", "p.Y", "p.Z", valid.alias("valid"), *keep)


def centred(detections: DataFrame, height: int, width: int, min_confidence: float = 0.0) -> DataFrame:
    """Detections of enough confidence, or of none, with the centre of their box (cx, cy) and its nearest pixel (v, u)."""
    cx, cy = G.bbox_center("bbox")
    kept = detections.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    return kept.withColumns({"cx": cx, "cy": cy}).withColumns({"v": G.pixel_index("cy", height), "u": G.pixel_index("cx", width)})


def position(k: Intrinsics) -> Column:
    """The projected centre of a box at depth z."""
    p = G.back_project("cx", "cy", "z", k, "double")
    return F.struct(p["X"].alias("x"), p["Y"].alias("y"), p["Z"].alias("z"))


def attach_text(detections: DataFrame, depth: DataFrame, height: int, width: int, k: Intrinsics, min_confidence: float = 0.0, depth_scale: float = 1.0) -> DataFrame:
    """(frame_idx, text, bbox, confidence) to 3-D annotations at the depth of each box's centre.

    The centre itself is projected; its nearest pixel gives the depth. Detections of null confidence stay, those under the least don't; annotations without a valid scaled depth are dropped.
    """
    at = centred(detections, height, width, min_confidence)
    z = at_pixels(at, depth).withColumn("z", F.col("z").cast("double") * F.lit(float(depth_scale))).where(G.valid_depth("z"))
    return z.select("frame_idx", "text", position(k).alias("position_3d"), "confidence", F.struct("u", "v").alias("pixel_uv"))


def annotation_json(annotations: DataFrame) -> DataFrame:
    """(frame_idx, json): each annotation as a document of text, position_3d, confidence and pixel_uv; nulls stay in it."""
    fields = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANNOTATION_3D])
    return annotations.select("frame_idx", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def ocr_filter(tokens: DataFrame, min_conf: int = DEFAULTS.min_ocr_conf) -> DataFrame:
    """Tokens of enough confidence whose trimmed text isn't empty; the text is stored trimmed."""
    return tokens.withColumn("text", F.trim("text")).where((F.col("conf") >= min_conf) & (F.col("text") != ""))


def sample_frames(frames: DataFrame, skip: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % skip == 0)


PATCH = ("clip_id", "slot", "patch_idx")


def with_patch(tracks: DataFrame, slots: int) -> DataFrame:
    """``tracks`` with the slot of their frame and the patch of their pixel."""
    return tracks.withColumns({"slot": G.temporal_slot("frame_idx", slots), "patch_idx": G.patch_index("x", "y")})


def semantic_lookup(tracks: DataFrame, features: DataFrame, slots: int) -> DataFrame:
    """Embedding of each tracked point: its patch's, at its frame's slot."""
    return with_patch(tracks, slots).join(features, list(PATCH)).select("clip_id", "frame_idx", "track_id", "embedding")


def depth_sort(points: DataFrame, view_row: tuple[float, float, float, float]) -> DataFrame:
    """Points back to front, ties by the larger index first; with the key scaled to [0, 1]. A cloud may be of any size: see ``ranked``."""
    keyed = points.withColumn("depth_key", G.depth_key("x", "y", "z", view_row))
    out = ranked(keyed, ["cloud_id"], [F.desc("depth_key"), F.desc("idx")], "draw_rank", low=("min", "depth_key"), high=("max", "depth_key"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("depth_key") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return out.withColumn("depth_share", scaled).drop("low", "high")
