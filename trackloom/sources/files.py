"""Tables from files. Paths go through Spark's readers, so any file system it knows will do."""

from __future__ import annotations

import io
import logging
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DEPTH_MAP, POINT_CLOUD, TRACKING, TRAJECTORY, TRAJECTORY_PART
from .versions import Versions

log = logging.getLogger(__name__)
IMAGES = (".png", ".jpg", ".jpeg")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or the warehouse where none is set.

    A warehouse on a machine's own disk will do for a local master alone; on a cluster it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        own = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getScheme() == "file"
        if own and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{root} is a folder of one machine: set spark.checkpoint.dir to one that all executors share")
    return f"{root.rstrip('/')}/trackloom-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and what was dealt or drawn stays as it is."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession, path: str) -> str:
    """Where a table's files are: its newest committed version, or the folder itself if it has no versions."""
    return Versions(spark, path).current() or path


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was last committed. Filters and columns that a query asks for reach the scan."""
    return spark.read.schema(TRACKING).parquet(table_path(spark, path))


class TrackStore:
    """A tracking table that may not exist yet: asking it then is a RuntimeError."""

    def __init__(self, spark: SparkSession, path: str):
        versions = Versions(spark, path)
        self._df = read_tracking(spark, path) if versions.current() or exists(spark, path) and not exists(spark, f"{path}/versions") else None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise RuntimeError("no tracking table is loaded")
        return self._df


def read_point_cloud(spark: SparkSession, path: str) -> DataFrame | None:
    """CSV with header; a missing file is logged and gives None."""
    if not exists(spark, path):
        log.warning("no point cloud at %s", path)
        return None
    return spark.read.option("header", True).schema(POINT_CLOUD).csv(path)


def _files(spark: SparkSession, path: str, glob: str | None = None, deep: bool = False) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def frame_files(spark: SparkSession, path: str, glob: str, wanted: Callable[[int], bool] | None = None) -> DataFrame:
    """Files of a folder whose names end in a frame's number and which are wanted by it: the others are listed, not opened."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{glob}")
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []
    names = [(s.getPath().toString(), re.search(r"(\d+)\.[^./]+$", s.getPath().getName())) for s in found if s.isFile()]
    if not names:
        raise FileNotFoundError(f"{path}/{glob}")
    some = [p for p, number in names if wanted is None or number and wanted(int(number[1]))]
    return spark.read.format("binaryFile").load(some) if some else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def read_depth_maps(spark: SparkSession, path: str, glob: str = "frame_*.npy", wanted: Callable[[int], bool] | None = None) -> DataFrame:
    """One file of depths per frame, named by number, to one row per frame: (frame_idx, height, width, depth), row by row.

    ``wanted`` chooses frames by number, before any file is opened. A file that doesn't hold an array of two dimensions with any value fails the query.
    """
    files = frame_files(spark, path, glob, wanted)
    number = F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("long")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, content in zip(b["frame_idx"], b["content"], strict=True):
                z = np.load(io.BytesIO(content)).astype(np.float32)
                if z.ndim != 2 or not z.size:
                    raise ValueError(f"frame {frame}: depths must have two dimensions and a value, not the shape {z.shape}")
                yield pd.DataFrame({"frame_idx": [frame], "height": [z.shape[0]], "width": [z.shape[1]], "depth": [z.ravel()]})

    return files.select(number.alias("frame_idx"), "content").mapInPandas(load, DEPTH_MAP)


def read_depth_frames(spark: SparkSession, path: str, glob: str = "frame_*.npy", wanted: Callable[[int], bool] | None = None) -> DataFrame:
    """The same files, a row for each pixel: (frame_idx, v, u, z)."""
    px = read_depth_maps(spark, path, glob, wanted).select("frame_idx", "width", F.posexplode("depth").alias("i", "z"))
    return px.select("frame_idx", F.expr("cast(i div width as int)").alias("v"), F.expr("cast(i % width as int)").alias("u"), "z")


def list_images(spark: SparkSession, path: str, max_frames: int = 20) -> DataFrame:
    """The first images of a folder by path, numbered: (frame_idx, path, content)."""
    end = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    first = _files(spark, path).where(end.isin(*IMAGES)).orderBy("path").limit(max_frames)
    from pyspark.sql import Window

    return first.select((F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("frame_idx"), "path", "content")


def read_video(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[bytes]], max_frames: int = 300) -> DataFrame:
    """Frames of video files through a decoder of the caller's: (path, frame_idx, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                frames = [x for _, x in zip(range(max_frames), decode(content), strict=False)]
                yield pd.DataFrame({"path": p, "frame_idx": range(len(frames)), "content": frames})

    return _files(spark, path).select("path", "content").mapInPandas(run, "path string, frame_idx long, content binary")


def file_hashes(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SHA-256 of every file below a path that has any bytes (Spark lists no empty ones): (file, bytes, digest)."""
    f = _files(spark, path, deep=True)
    ends = lambda e: F.lower("path").endswith(e)
    if extensions is not None:
        keep = F.lit(False)
        for e in extensions:
            keep = keep | ends(e)
        f = f.where(keep)
    for e in exclude:
        f = f.where(~ends(e))
    return f.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def scan_cache(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, last_used) of the files of a cache; recency is their modification time."""
    return _files(spark, path, deep=True).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("last_used"))


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """The nested document as rows (fps, id, path)."""
    return spark.read.schema(TRAJECTORY).option("multiLine", True).json(path).select("fps", F.inline("tracks"))


def read_trajectory_parts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of parts of paths as rows (fps, id, part, path)."""
    return spark.read.schema(TRAJECTORY_PART).json(path)
