"""Schemas of the data model, and the defaults of its operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_L, _F, _I, _D, _S, _B = T.LongType(), T.FloatType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A tracked point: one row per track and frame.
TRACKING = _struct(track_id=_L, frame_idx=_L, x=_F, y=_F, z=_F, ocr_text=_S, confidence=_F)
#: Projected points as they are exchanged by CSV.
POINT_CLOUD = _struct(frame_id=_L, point_id=_L, X=_F, Y=_F, Z=_F, valid=_B)
DEPTH = _struct(frame_idx=_L, v=_I, u=_I, z=_F)
#: A frame's depths as one array, row by row.
DEPTH_MAP = _struct(frame_idx=_L, height=_I, width=_I, depth=T.ArrayType(_F))
#: One row per patch of a clip's temporal slot.
PATCH_FEATURES = _struct(clip_id=_L, slot=_I, patch_idx=_I, embedding=T.ArrayType(_F))
INDEX = _struct(track_id=_L, page_content=_S, text_vec=T.ArrayType(_D), embedding=T.ArrayType(_F), class_name=_S, metadata=T.MapType(_S, _S))
BBOX = _struct(x=_I, y=_I, w=_I, h=_I)
OCR_DETECTION = _struct(frame_idx=_L, text=_S, bbox=BBOX, conf=_I)
ANNOTATION_3D = _struct(text=_S, position_3d=_struct(x=_D, y=_D, z=_D), confidence=_D, pixel_uv=_struct(u=_I, v=_I))
PATH_POINT = _struct(f=_L, x=_D, y=_D, z=_D, r=_D, g=_D, b=_D)
TRAJECTORY = _struct(fps=_I, tracks=T.ArrayType(_struct(id=_L, path=T.ArrayType(PATH_POINT))))
TRAJECTORY_PART = _struct(fps=_I, id=_L, part=_L, path=T.ArrayType(PATH_POINT))
#: A record of a cache's log: op is put, touch or evict; records are in order of at, writer, seq.
CACHE_LOG = _struct(key=_S, op=_S, bytes=_L, at=_L, writer=_S, seq=_L, data=_S)
CACHE_ENTRY = _struct(key=_S, name=_S, bytes=_L, last_used=_L)


@dataclass(frozen=True)
class Intrinsics:
    """A pinhole camera; focal lengths are positive."""

    fx: float
    fy: float
    cx: float
    cy: float

    def __post_init__(self) -> None:
        if self.fx <= 0 or self.fy <= 0:
            raise ValueError("focal lengths must be positive")

    @classmethod
    def of_size(cls, height: int, width: int) -> Intrinsics:
        side = float(max(height, width))
        return cls(side, side, width / 2, height / 2)


@dataclass(frozen=True)
class Defaults:
    """Parameters that operators take when none is given."""

    grid_step: int = 20
    frame_size: int = 224
    patch: int = 16
    patches_per_side: int = 14
    pca_dim: int = 64
    placeholder_dim: int = 128
    radius: float = 1.0
    max_neighbors: int = 32
    window: int = 16
    overlap: int = 4
    top_k: int = 5
    min_ocr_conf: int = 40
    cache_bytes: int = 10 * 1024**3
    latency_ms: float = 150.0
    runs: int = 20
    warmup: int = 2
    fps: int = 30


DEFAULTS = Defaults()
