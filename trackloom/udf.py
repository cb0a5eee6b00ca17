"""Extension points: models and detectors that run on the executors, loaded once for each partition."""

from __future__ import annotations

import atexit
import io
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import DEFAULTS, OCR_DETECTION


class Model(ABC):
    """``load`` is called once in a worker before ``predict`` gets pandas batches."""

    def __init__(self, path: str | None = None):
        if path is not None and not path:
            raise ValueError("a model path can't be empty")
        self.path = path

    @abstractmethod
    def load(self) -> None: ...

    @abstractmethod
    def predict(self, batch: pd.DataFrame) -> pd.DataFrame: ...

    def release(self) -> None:  # noqa: B027
        """After the last batch."""


def apply_model(df: DataFrame, model: Model, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        try:
            for b in batches:
                yield model.predict(b)
        finally:
            model.release()

    return df.mapInPandas(run, schema)


def apply_per_clip(df: DataFrame, model: Model, schema: str | T.StructType) -> DataFrame:
    """For models that need a whole clip: one group per clip. The model is loaded once in a task, with its first clip."""
    loaded: list[Model] = []

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        if not loaded:
            model.load()
            loaded.append(model)
            atexit.register(model.release)
        return model.predict(clip.sort_values("frame_idx"))

    return df.groupBy("clip_id").applyInPandas(run, schema)


class StubDepth(Model):
    """A deterministic depth per frame: stands where a real model is not installed."""

    ENCODERS = ("vits", "vitb", "vitl", "vitg")

    def __init__(self, encoder: str = "vits", path: str | None = None):
        super().__init__(path)
        if encoder not in self.ENCODERS:
            raise ValueError(f"encoder must be one of {self.ENCODERS}")
        self.encoder = encoder

    def load(self) -> None:
        self.offset = 1.0 + self.ENCODERS.index(self.encoder)

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        mean = [float(np.frombuffer(c, np.uint8).mean()) if len(c) else 0.0 for c in batch["content"]]
        return pd.DataFrame({"frame_idx": batch["frame_idx"], "depth": np.array(mean) / 255 + self.offset})


class StubTracker(Model):
    """Moves its query points by a constant step; needs a grid size or queries."""

    def __init__(self, grid_size: int | None = None, queries: list[tuple[float, float]] | None = None, size: int = 224, speed: float = 2.5):
        super().__init__()
        if grid_size is None and queries is None:
            raise ValueError("grid_size or queries is required")
        side = [size * (i + 0.5) / grid_size for i in range(grid_size or 0)]
        self.points, self.speed = queries or [(x, y) for y in side for x in side], speed

    def load(self) -> None: ...

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        t = batch["frame_idx"].to_numpy()
        n = len(self.points)
        at = np.array(self.points, "float32")
        move = np.repeat(t - (t[0] if len(t) else 0), n).astype("float32") * self.speed
        return pd.DataFrame({"clip_id": np.repeat(batch["clip_id"].to_numpy(), n), "frame_idx": np.repeat(t, n), "track_id": np.tile(np.arange(n), len(t)), "x": np.tile(at[:, 0], len(t)) + move, "y": np.tile(at[:, 1], len(t)) + move, "visible": True})


class StubEmbedder(Model):
    """Patch embeddings of a clip that follow from its numbers: stands where a video model is not installed."""

    SIZES = {"vitl": 1024, "vith": 1280, "vitg": 1408, "vitg_384": 1408}

    def __init__(self, size: str = "vitl", slots: int = 2, dim: int | None = None):
        super().__init__()
        if size not in self.SIZES:
            raise ValueError(f"size must be one of {sorted(self.SIZES)}")
        self.slots, self.dim, self.patches = slots, dim or self.SIZES[size], DEFAULTS.patches_per_side**2

    def load(self) -> None: ...

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        n, clip = self.slots * self.patches, int(batch["clip_id"].iloc[0])
        token = np.arange(n)
        rows = ((token[:, None] * 31 + np.arange(self.dim) * 7 + clip) % 97 / 97).astype("float32")
        return pd.DataFrame({"clip_id": clip, "slot": (token // self.patches).astype("int32"), "patch_idx": (token % self.patches).astype("int32"), "embedding": list(rows)})


@dataclass(frozen=True)
class OcrConfig:
    """How a frame is prepared for a detector that takes pixels: ``method`` is otsu or adaptive."""

    threshold: bool = True
    method: str = "otsu"
    scale: float = 1.0
    engine: str = ""
    denoised: bool = False

    def __post_init__(self) -> None:
        if self.method not in ("otsu", "adaptive") or self.scale <= 0:
            raise ValueError("method must be otsu or adaptive, and scale positive")


def detect_text(frames: DataFrame, detector: Callable[..., list[dict]], min_conf: int = DEFAULTS.min_ocr_conf, frame_skip: int = 1, config: OcrConfig | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Detections of sampled frames, with the frames' columns ``keep``; frames are skipped before the detector sees them.

    The detector gets a frame's content. With a ``config``, content is an array file of shape (height, width, 3), blue first:
    the detector gets the prepared grey image and the engine's options, and its boxes are scaled back to the frame.
    """
    from .functions.image import prepare
    from .operators.projection import ocr_filter, sample_frames

    def of_frame(content: bytes) -> list[dict]:
        if config is None:
            return detector(content)
        found = detector(prepare(np.load(io.BytesIO(content)), config.threshold, config.method, config.scale, config.denoised), config.engine)
        return [d | {"bbox": {k: int(x / config.scale) for k, x in d["bbox"].items()}} for d in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"frame_idx": f, **d, **dict(zip(keep, more, strict=True))} for f, c, *more in zip(*(b[n] for n in ("frame_idx", "content", *keep)), strict=True) for d in of_frame(c)]
            yield pd.DataFrame(rows, columns=["frame_idx", "text", "bbox", "conf", *keep])

    schema = T.StructType([*OCR_DETECTION, *[frames.schema[c] for c in keep]])
    return ocr_filter(sample_frames(frames, frame_skip).select("frame_idx", "content", *keep).mapInPandas(run, schema), min_conf)


def time_ms(f: Callable, *args) -> tuple[object, float]:
    began = time.perf_counter()
    return f(*args), (time.perf_counter() - began) * 1000


def measure(spark, f: Callable, runs: int = 20, warmup: int = 2, threshold_ms: float = 150.0, stages: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Latency report of a callable and, if given, the breakdown of its stages."""
    from .operators.stats import latency_stats, stage_breakdown

    for name, s in (stages or {}).items():
        if not callable(s):
            raise TypeError(f"stage {name} isn't callable")
    times = [(i, time_ms(f)[1]) for i in range(runs)]
    report = latency_stats(spark.createDataFrame(times, "run_idx int, latency_ms double"), None, warmup, threshold_ms)
    parts = [(n, time_ms(s)[1]) for n, s in (stages or {}).items()]
    return report, stage_breakdown(spark.createDataFrame(parts, "stage string, ms double")) if parts else None


def report_text(report: DataFrame, stages: DataFrame | None = None, threshold_ms: float = DEFAULTS.latency_ms) -> str:
    """The report of ``measure`` as lines, PASS or FAIL last."""
    r = report.first()
    lines = [f"{s['stage']}: {s['ms']:.2f} ms" for s in (stages.orderBy(F.col("stage") == "total", "stage").collect() if stages is not None else [])]
    lines.append(f"runs {r['runs']}, mean {r['mean_ms']:.2f} ms, deviation {r['std_ms']:.2f} ms, {r['fps']:.1f} frames a second")
    return "\n".join([*lines, f"{'PASS' if r['within_threshold'] else 'FAIL'}: mean under {threshold_ms:g} ms"])


def simulated_stages(spark, n: int = 10_000, height: int = 720, width: int = 1280) -> dict[str, Callable[[], int]]:
    """Stages over seeded data for ``measure``: products of vectors, projection of points, a radius graph of 1.5."""
    from .functions import vectors as V
    from .operators.graph import radius_edges
    from .operators.projection import depth_maps, project_to_3d
    from .sources import generators as gen

    v = gen.random_vectors(spark, 2000, 64)
    points = gen.random_tracks(spark, 1, n, min(height, width))
    maps = depth_maps(gen.random_depth(spark, 1, height, width))
    nodes = gen.random_vectors(spark, 500, 3).select(F.lit(0).alias("graph_id"), F.col("id").alias("node_idx"), *[(F.get("embedding", F.lit(i)) * 5).alias(c) for i, c in enumerate(("px", "py", "pz"))])
    return {
        "products": lambda: v.select(V.dot("embedding", F.reverse("embedding")).alias("x")).where("x is not null").count(),
        "projection": lambda: project_to_3d(points, maps, height, width).where("valid").count(),
        "graph": lambda: radius_edges(nodes, 1.5).count(),
    }
