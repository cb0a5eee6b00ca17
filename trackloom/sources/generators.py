"""Generated tables. Random ones are seeded by their keys, so every run and every partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)).cast("double") / float(1 << 53)


def grid_points(spark: SparkSession, height: int, width: int, step: int = 20) -> DataFrame:
    """(id, x, y): every ``step`` pixels, row by row."""
    nx, ny = -(-width // step), -(-height // step)
    i = F.col("id")
    return spark.range(nx * ny).select("id", (i % nx * step).cast("float").alias("x"), (F.floor(i / nx) * step).cast("float").alias("y"))


def start_queries(points: DataFrame) -> DataFrame:
    return points.select(F.lit(0.0).alias("frame"), "x", "y")


def linear_tracks(points: DataFrame, n_frames: int, speed: float = 2.5) -> DataFrame:
    """Each point moved by ``speed`` a frame on both axes: (frame_idx, track_id, x, y, visible)."""
    t = points.withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_frames - 1).cast("long")))) if n_frames > 0 else points.withColumn("frame_idx", F.lit(0).cast("long")).where("false")
    move = lambda c: (F.col(c) + F.col("frame_idx") * F.lit(speed)).cast("float").alias(c)
    return t.select("frame_idx", F.col("id").alias("track_id"), move("x"), move("y"), F.lit(True).alias("visible"))


def random_depth(spark: SparkSession, n_frames: int, height: int, width: int, seed: int = 42, low: float = 1.0, high: float = 10.0) -> DataFrame:
    n = height * width
    i = F.col("id")
    pixel = spark.range(n_frames * n).select(F.floor(i / n).alias("frame_idx"), F.floor(i % n / width).cast("int").alias("v"), (i % width).cast("int").alias("u"))
    return pixel.withColumn("z", (uniform(seed, "frame_idx", "v", "u") * (high - low) + low).cast("float"))


def mock_tracks(spark: SparkSession, n_frames: int = 300) -> DataFrame:
    """Two straight tracks in the tracking schema."""
    f = F.col("frame_idx")
    line = lambda a, b: (F.lit(float(a)) + F.lit(float(b - a)) * f / float(max(n_frames - 1, 1)))
    x, y = line(100, 400), line(150, 300)
    ids = spark.range(2 * n_frames).select((F.floor(F.col("id") / n_frames) + 1).alias("track_id"), (F.col("id") % n_frames).alias("frame_idx"))
    far = F.col("track_id") - 1
    return ids.select("track_id", "frame_idx", (x + far * 100).cast("float").alias("x"), (y + far * 100).cast("float").alias("y"), F.lit(5.0).cast("float").alias("z"), F.lit("").alias("ocr_text"), F.lit(1.0).cast("float").alias("confidence"))


def random_tracks(spark: SparkSession, n_frames: int, n_tracks: int, size: int = 224, seed: int = 42, clip_id: int = 0) -> DataFrame:
    i = F.col("id")
    t = spark.range(n_frames * n_tracks).select(F.lit(clip_id).alias("clip_id"), F.floor(i / n_tracks).alias("frame_idx"), (i % n_tracks).alias("track_id"))
    at = lambda k: (uniform(seed + k, "clip_id", "frame_idx", "track_id") * size).cast("float")
    return t.withColumns({"x": at(0), "y": at(1), "visible": F.lit(True)})


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(id, embedding) with components in [-1, 1)."""
    part = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (uniform(seed, "id", j) * 2 - 1).cast("float"))
    return spark.range(n).withColumn("embedding", part)


def random_clip(spark: SparkSession, n_frames: int = 4, channels: int = 3, size: int = 224, seed: int = 42) -> DataFrame:
    """(frame_idx, channel, pixels): a synthetic clip with values in [0, 1)."""
    i = F.col("id")
    planes = spark.range(n_frames * channels).select(F.floor(i / channels).alias("frame_idx"), (i % channels).cast("int").alias("channel"))
    return planes.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda j: uniform(seed, "frame_idx", "channel", j).cast("float")))
