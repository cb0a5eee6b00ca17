"""Streams of frames: windows, index growth, running moments, error counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import windows_of_frames
from ..schemas import DEFAULTS


def read_frames(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def window_counts(frames: DataFrame, by: str = "clip_id", n_frames: int = 1 << 40, window: int = DEFAULTS.window, overlap: int = DEFAULTS.overlap) -> DataFrame:
    """Frames and mean value by clip and overlapping frame window; runs on a table and on a stream alike."""
    w = windows_of_frames(frames.withColumn("n_frames", F.lit(n_frames)), "n_frames", window, overlap)
    return w.groupBy(by, "window_id").agg(F.count("*").alias("frames"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, ts: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window, rows later than ``late`` left out."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return t.groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", *keys, "n")


def grow_index(frames: DataFrame, to_rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends the index rows of each micro-batch. A batch that is repeated after a failure replaces its own folder."""

    def append(batch: DataFrame, epoch: int) -> None:
        to_rows(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return frames.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunningPCA:
    """PCA over batches by their moments: count, sum and outer products, of the size of the dimension alone.

    The moments of a batch are one aggregation on the executors; a batch of any size counts.
    """

    def __init__(self, dim: int):
        self.n, self.s, self.p = 0, np.zeros(dim), np.zeros((dim, dim))

    def update(self, batch: DataFrame, column: str = "embedding") -> RunningPCA:
        def moments(parts):
            import pandas as pd

            for b in parts:
                x = np.stack(b[column].to_numpy()).astype(float) if len(b) else np.zeros((0, len(self_s)))
                yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "p": [(x.T @ x).ravel().tolist()]})

        self_s = self.s
        parts = batch.select(column).mapInPandas(moments, "n long, s array<double>, p array<double>")
        each = parts.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "p")).alias("i", "x"))
        d = len(self.s)
        for i, x in each.groupBy("i").agg(F.sum("x").alias("x")).collect():  # 1 + d + d * d numbers
            if not i:
                self.n += round(x)
            elif i <= d:
                self.s[i - 1] += x
            else:
                self.p[(i - 1 - d) // d, (i - 1 - d) % d] += x
        return self

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(k components by row, their variances)."""
        if self.n < 2:
            raise ValueError("at least two rows are needed")
        mean = self.s / self.n
        cov = (self.p - self.n * np.outer(mean, mean)) / (self.n - 1)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[:k]
        return vectors[:, order].T, values[order]


def run_guarded(frames: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, max_errors: int = 5, dead_letters: str | None = None) -> tuple[StreamingQuery, dict]:
    """Processes micro-batches, counting failures; more than ``max_errors`` in all end the query.

    A batch that fails is written to ``dead_letters`` (beside the checkpoint if none is named) as epoch=n, so its rows can be
    processed again; the state returned names the epochs. One that ends the query isn't: the next start repeats it.
    """
    state: dict = {"batches": 0, "errors": 0, "failed": []}
    kept = dead_letters or f"{checkpoint.rstrip('/')}-failed"

    def each(batch: DataFrame, epoch: int) -> None:
        state["batches"] += 1
        try:
            process(batch, epoch)
        except Exception:
            state["errors"] += 1
            if state["errors"] > max_errors:
                raise
            batch.write.mode("overwrite").parquet(f"{kept}/epoch={epoch}")
            state["failed"].append(epoch)

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), state
