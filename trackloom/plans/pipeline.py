"""From frames to a fusion graph, and to prepared embeddings, as lazy chains of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import embeddings as E
from ..operators.graph import build_fusion_graph
from ..operators.projection import PATCH, attach_text, project_to_3d, require_depth, semantic_lookup, with_patch
from ..schemas import DEFAULTS, PATCH_FEATURES, Intrinsics
from ..udf import Model, OcrConfig, apply_per_clip, detect_text

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    """Stages one after the other; each sees the whole table of the one before, and nothing runs until the end."""
    for s in stages:
        df = df.transform(s)
    return df


def annotate_frames(
    frames: DataFrame, depth: DataFrame, detector: Callable[[bytes], list[dict]], k: Intrinsics, height: int, width: int, min_confidence: float = 0.0, depth_scale: float = 1.0, frame_skip: int = 1, ocr: OcrConfig | None = None, check: bool = True
) -> DataFrame:
    """Frames (frame_idx, content) and their depth maps to 3-D text annotations: detect, then attach, all frames in one plan.

    Images and depths meet by frame number; a frame without the other one gives nothing. Confidence is the detector's, 0 to
    100. The plan is lazy but for the check of the maps, and runs on a stream's micro-batch as on a table.
    """
    if check and "depth" in depth.columns:
        require_depth(depth)
    found = detect_text(frames, detector, frame_skip=frame_skip, config=ocr).withColumn("confidence", F.col("conf").cast("double"))
    return attach_text(found, depth, height, width, k, min_confidence, depth_scale)


def extract_semantics(frames: DataFrame, tracker: Model, embedder: Model, slots: int) -> DataFrame:
    """Clips (clip_id, frame_idx, content) to semantic tracks: tracked, embedded and mapped to each other in one plan."""
    tracks = apply_per_clip(frames, tracker, "clip_id long, frame_idx long, track_id long, x double, y double, visible boolean")
    return semantic_lookup(tracks, apply_per_clip(frames, embedder, PATCH_FEATURES), slots)


def require_aligned(positions: DataFrame, embeddings: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> None:
    """ValueError unless both have equally many rows for each value of ``keys``."""
    n = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    bad = n(positions, "a").join(n(embeddings, "b"), list(keys), "full").where("not (a <=> b)").limit(3).collect()
    if bad:
        raise ValueError(f"positions and embeddings differ in number: {[tuple(r) for r in bad]}")


def fusion_graph_of_clip(tracks: DataFrame, depth: DataFrame, features: DataFrame, slots: int, height: int, width: int, radius: float = 1.5, drop_invalid: bool = False, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tracks (clip_id, frame_idx, track_id, x, y), depth and patch features to the graphs of all frames: nodes, edges.

    A frame is a graph. A point keeps its patch through the projection, so points are not joined with themselves. Points with an invalid depth stay unless ``drop_invalid``. ``check``: frames whose points and
    embeddings differ in number are a ValueError; otherwise a point without one is a ghost node.
    """
    p = project_to_3d(with_patch(tracks, slots), depth, height, width, keep=PATCH)
    p = p.where("valid") if drop_invalid else p
    if check:
        require_aligned(p, semantic_lookup(tracks, features, slots).select(F.col("frame_idx").alias("frame_id")))
    nodes = p.join(features.select(*PATCH, "embedding"), list(PATCH), "left").select(F.col("frame_id").alias("graph_id"), F.col("point_id").alias("node_idx"), F.col("point_id").alias("track_id"), F.col("X").alias("px"), F.col("Y").alias("py"), F.col("Z").alias("pz"), "embedding")
    return build_fusion_graph(nodes, radius, placeholder_dim=DEFAULTS.pca_dim)


def prepare_embeddings(semantic: DataFrame, model: PipelineModel | None = None, k: int = DEFAULTS.pca_dim, normalize: bool = True, weight: str | None = None) -> tuple[DataFrame, PipelineModel]:
    """Semantic tracks (clip_id, track_id, frame_idx, embedding) to one vector per clip and track, and the PCA used.

    Reduce, average over frames (by weight, if a column is named), normalise. All clips are kept.
    """
    model = model or E.fit_pca(semantic, k)
    keyed = E.transform_pca(model, semantic).withColumn("key", F.struct("clip_id", "track_id"))
    out = E.identity_embedding(keyed, "key", weight).select("key.clip_id", "key.track_id", "embedding")
    return (out.withColumn("embedding", V.l2_normalize("embedding")) if normalize else out), model
