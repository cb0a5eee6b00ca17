"""Reports on runs, caches and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULTS
from .ranking import beyond


def latency_stats(runs: DataFrame, by: list[str] | None = None, warmup: int = DEFAULTS.warmup, threshold_ms: float = DEFAULTS.latency_ms) -> DataFrame:
    """(run_idx, latency_ms) to mean, sample deviation (0 for one run), extremes, frames a second and the verdict."""
    mean = F.avg("latency_ms")
    s = runs.where(F.col("run_idx") >= warmup).groupBy(*(by or [])).agg(
        F.count("*").alias("runs"), mean.alias("m"), F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("s"), F.min("latency_ms").alias("lo"), F.max("latency_ms").alias("hi")
    )
    return s.select(*(by or []), "runs", F.round("m", 4).alias("mean_ms"), F.round("s", 4).alias("std_ms"), F.round("lo", 4).alias("min_ms"), F.round("hi", 4).alias("max_ms"), F.round(1000 / F.col("m"), 2).alias("fps"), (F.col("m") < threshold_ms).alias("within_threshold"))


def stage_breakdown(times: DataFrame) -> DataFrame:
    """(stage, ms) to the sum of each stage, and the total under stage 'total'."""
    total = F.when(F.grouping("stage") == 1, F.lit("total")).otherwise(F.col("stage"))
    return times.rollup("stage").agg(total.alias("name"), F.sum("ms").alias("ms")).select(F.col("name").alias("stage"), "ms")


def endurance_rows(log: DataFrame, limit_mb: float = 150.0) -> DataFrame:
    """(series, clip, ram_mb) with the growth since the series' first clip and its status."""
    first = F.first("ram_mb").over(Window.partitionBy("series").orderBy("clip").rowsBetween(Window.unboundedPreceding, 0))
    d = log.withColumn("delta_mb", F.col("ram_mb") - first)
    return d.withColumn("status", F.when(F.col("delta_mb") > limit_mb, "FAIL").when(F.col("delta_mb") > limit_mb / 2, "WARN").otherwise("OK"))


def endurance_verdict(log: DataFrame, limit_mb: float = 150.0, trend_mb: float = 30.0) -> DataFrame:
    """By series: total growth, trend (mean of the last ten less that of the first ten, from 20 clips on) and failure."""
    w = Window.partitionBy("series")
    n = log.withColumns({"a": F.row_number().over(w.orderBy("clip")), "d": F.row_number().over(w.orderBy(F.desc("clip"))), "n": F.count("*").over(w)})
    g = n.groupBy("series").agg(F.max("n").alias("clips"), (F.max(F.when(F.col("d") == 1, F.col("ram_mb"))) - F.max(F.when(F.col("a") == 1, F.col("ram_mb")))).alias("growth_mb"), (F.avg(F.when(F.col("d") <= 10, F.col("ram_mb"))) - F.avg(F.when(F.col("a") <= 10, F.col("ram_mb")))).alias("t"))
    return g.select("series", "clips", "growth_mb", F.when(F.col("clips") >= 20, F.col("t")).otherwise(F.col("growth_mb")).alias("trend_mb")).withColumn("failed", (F.col("growth_mb") > limit_mb) & (F.col("trend_mb") > trend_mb))


def cache_stats(entries: DataFrame, max_bytes: int = DEFAULTS.cache_bytes) -> DataFrame:
    """(key, bytes, last_used) to entries, sizes and the share of the budget (null for no budget)."""
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    return entries.agg(F.count("*").alias("entries"), total.alias("b")).select("entries", (F.col("b") / 2**20).alias("mb"), (F.col("b") / 2**30).alias("gb"), F.lit(max_bytes / 2**30).alias("max_gb"), (F.lit(100.0) * F.col("b") / F.lit(max_bytes or None)).alias("usage_percent"))


def lru_evict(entries: DataFrame, max_bytes: int, incoming: int = 0) -> DataFrame:
    """Entries of (cache_id, key, bytes, last_used) that must go, oldest first, so that the rest and ``incoming`` fit.

    An entry larger than its whole budget doesn't take the others with it: it goes alone. Caches aren't sorted: see ``beyond``.
    """
    entries = entries.select("cache_id", "key", "bytes", "last_used")
    large = F.coalesce(F.col("bytes") > max_bytes - incoming, F.lit(False))
    return entries.where(large).unionByName(beyond(entries.where(~large), "cache_id", ["last_used", "key"], "bytes", max_bytes - incoming))


def size_reduction(sizes: DataFrame) -> DataFrame:
    """(name, bytes_before, bytes_after) with the reduction in percent."""
    return sizes.withColumn("reduction_percent", F.when(F.col("bytes_before") > 0, 100 * (1 - F.col("bytes_after") / F.col("bytes_before"))))


def frames_per_second(frames: DataFrame, ts: str = "ts") -> DataFrame:
    """Frames and distinct tracks in every second that has any."""
    return frames.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("frames"), F.count_distinct("track_id").alias("active_tracks"))
