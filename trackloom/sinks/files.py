"""Writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks import trajectory_document, trajectory_parts
from ..schemas import DEFAULTS, TRACKING
from ..sources.versions import Versions


class TrackWriter:
    """Writes a tracking table in sessions: batches are added until ``close``, which puts them in the old table's place at once.

    Until then readers see the old table. ``abort``, or an exception within ``with``, drops the session's batches, and a
    writer that dies leaves the old table as it is. The batch after a close begins a new session.
    """

    def __init__(self, spark: SparkSession, path: str, compression: str = "snappy", block_bytes: int | None = None):
        self.spark, self.versions, self.session = spark, Versions(spark, path), None
        self.options = {"compression": compression} | ({"parquet.block.size": str(block_bytes)} if block_bytes else {})

    def __enter__(self) -> TrackWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.close()
        else:
            self.abort()

    def write(self, rows: DataFrame) -> None:
        cast = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACKING])
        self.session = self.session or self.versions.begin()
        cast.write.mode("append").options(**self.options).parquet(self.versions.folder(self.session))

    def write_batch(self, **columns) -> None:
        """One list for each column of the schema, all equally long."""
        names = [f.name for f in TRACKING]
        if sorted(columns) != sorted(names):
            raise ValueError(f"columns must be {names}")
        if len({len(c) for c in columns.values()}) != 1:
            raise ValueError("columns differ in length")
        self.write(self.spark.createDataFrame(pd.DataFrame({n: list(columns[n]) for n in names})[names]))

    def write_from_dict(self, data: dict) -> None:
        self.write_batch(**data)

    def close(self) -> None:
        """Commits the session; without a batch there is nothing to commit."""
        if self.session is not None:
            self.versions.commit(self.session)
        self.session = None

    def abort(self) -> None:
        if self.session is not None:
            self.versions.abort(self.session)
        self.session = None


def write_point_cloud(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").option("header", True).csv(path)


def write_trajectories(points: DataFrame, path: str, fps: int = DEFAULTS.fps) -> None:
    """One document of one clip, for a viewer; tables of any size: ``write_trajectory_parts``."""
    trajectory_document(points, fps).coalesce(1).write.mode("overwrite").text(path)


def write_trajectory_parts(points: DataFrame, path: str, fps: int = DEFAULTS.fps) -> None:
    """A line of JSON for each part of a path, in as many files as there are tasks."""
    trajectory_parts(points, fps).write.mode("overwrite").json(path)


def write_manifest(hashes: DataFrame, name: str, path: str) -> None:
    """Lines ``name | file | digest``, by file."""
    hashes.orderBy("file").select(F.concat_ws(" | ", F.lit(name), "file", "digest").alias("value")).write.mode("overwrite").text(path)


def write_frames(tracks: DataFrame, path: str) -> None:
    """Tracks or depth in long form, a folder for each clip if there is a clip_id."""
    w = tracks.write.mode("overwrite")
    (w.partitionBy("clip_id") if "clip_id" in tracks.columns else w).parquet(path)
