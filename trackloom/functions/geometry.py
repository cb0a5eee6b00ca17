"""Scalar transforms on pixels, depths and boxes. All of them stay in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULTS, Intrinsics


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    return ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf"))


def pixel_index(v: Column | str, size: int | Column) -> Column:
    """Nearest pixel, halves to even, clipped to [0, size); null for NaN, which has no pixel."""
    top = (size if isinstance(size, Column) else F.lit(size)) - 1
    return F.when(~F.isnan(_c(v)), F.greatest(F.lit(0), F.least(F.rint(_c(v)), top))).cast("int")


def valid_depth(z: Column | str) -> Column:
    """Finite and positive; false for null."""
    return F.coalesce(finite(z) & (_c(z) > 0), F.lit(False))


def back_project(u: Column | str, v: Column | str, z: Column | str, k: Intrinsics, kind: str = "float") -> Column:
    """struct(X, Y, Z) of a pixel at a depth, in single or double precision."""
    lit = lambda a: F.lit(float(a)).cast(kind)
    x = ((_c(u).cast(kind) - lit(k.cx)) * _c(z).cast(kind) / lit(k.fx)).cast(kind)
    y = ((_c(v).cast(kind) - lit(k.cy)) * _c(z).cast(kind) / lit(k.fy)).cast(kind)
    return F.struct(x.alias("X"), y.alias("Y"), _c(z).cast(kind).alias("Z"))


def patch_index(x: Column | str, y: Column | str) -> Column:
    """Row-major patch of a point in a frame; coordinates outside are clipped."""
    along = lambda a: F.floor(F.least(F.greatest(_c(a), F.lit(0)), F.lit(DEFAULTS.frame_size - 1)) / DEFAULTS.patch)
    return (along(y) * DEFAULTS.patches_per_side + along(x)).cast("int")


def temporal_slot(frame_idx: Column | str, slots: int | Column) -> Column:
    return F.least(_c(frame_idx), (slots if isinstance(slots, Column) else F.lit(slots)) - 1).cast("int")


def bbox_center(bbox: str) -> tuple[Column, Column]:
    b = F.col(bbox)
    return b["x"] + b["w"] / 2, b["y"] + b["h"] / 2


def unscale_bbox(bbox: str, scale: float) -> Column:
    """Box in the unscaled frame, towards zero."""
    b = F.col(bbox)
    return b if scale == 1 else F.struct(*[(b[k] / scale).cast("int").alias(k) for k in "xywh"])


def frame_at(seconds: Column | str, fps: int | Column, n_frames: Column | str) -> Column:
    """Frame shown at a playback time, held at the last one."""
    rate = fps if isinstance(fps, Column) else F.lit(fps)
    return F.least(F.floor(_c(seconds) * rate), _c(n_frames) - 1)


def depth_key(x: Column | str, y: Column | str, z: Column | str, m: tuple[float, float, float, float]) -> Column:
    """Integer sort key of a point's view-space depth; ``m`` is the third row of the view matrix."""
    return F.floor((F.lit(m[0]) * _c(x) + F.lit(m[1]) * _c(y) + F.lit(m[2]) * _c(z) + F.lit(m[3])) * 1000)


def track_color(track_id: Column | str) -> tuple[Column, Column, Column]:
    """Red, green, blue in [0, 1): the same for all rows of a track and on every run."""
    return tuple(F.pmod(F.xxhash64(_c(track_id), F.lit(i)), F.lit(1000)) / 1000 for i in range(3))
