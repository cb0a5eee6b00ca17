"""Retrieve and enrich: one plan from a query vector to hits with their summaries and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.search import VectorIndex, nearest
from ..operators.tracks import track_answer, track_summary
from ..schemas import DEFAULTS
from ..sources.files import TrackStore


def enrich(hits: DataFrame, tracks: DataFrame, include_locations: bool = True) -> DataFrame:
    """``hits(track_id, ...)`` with found, the summary's columns and the locations; a hit without a track stays.

    The tracking table is cut to the hits' tracks by a semi-join before anything is computed on it.
    """
    ids = hits.select("track_id").distinct()  # its size decides how it is joined
    own = tracks.join(ids, "track_id", "left_semi")
    out = hits.join(track_summary(own), "track_id", "left").withColumn("found", F.col("num_frames").isNotNull())
    if include_locations:
        out = out.join(track_answer(own, ids).select("track_id", "locations"), "track_id", "left")
    return out


def answer(index: DataFrame, tracks: DataFrame, query: Column, k: int = DEFAULTS.top_k, vector: str = "embedding", where: dict | None = None, include_locations: bool = True) -> DataFrame:
    return enrich(nearest(index, query, k, where, vector), tracks, include_locations)


class Agent:
    """Questions over a saved index and a tracking table, either of which may be missing at the start."""

    def __init__(self, spark: SparkSession, index_path: str, tracks_path: str):
        self.index = VectorIndex(spark, index_path)
        try:
            self.index.load()
        except FileNotFoundError:
            pass
        self.store = TrackStore(spark, tracks_path)

    def query(self, text: str, k: int = DEFAULTS.top_k, include_locations: bool = True) -> DataFrame:
        return enrich(self.index.search(text, k), self.store.df, include_locations)

    def query_many(self, queries: DataFrame, k: int = DEFAULTS.top_k, include_locations: bool = True) -> DataFrame:
        """The answers to all questions (query_id, query) at once: one search, one pass over the tracks."""
        return enrich(self.index.search_many(queries, k), self.store.df, include_locations)

    def get_track(self, track_id: int, frame_idx: int | None = None) -> DataFrame:
        df = self.store.df
        return track_answer(df, df.sparkSession.createDataFrame([(track_id,)], "track_id long"), frame_idx)

    def objects_of_class(self, class_name: str, k: int = DEFAULTS.top_k) -> DataFrame:
        rows = self.index.rows
        if rows is None:
            raise RuntimeError("the index is empty")
        return nearest(rows, V.text_vector(F.lit(class_name), self.index.dim), k, {"class_name": class_name}, "text_vec")
