"""Incremental PCA of bounded rank: what is known of all rows so far is a few directions with their strengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Summaries that one task merges.
FAN = 64
_ROW = "id long, n long, total double, mean array<double>, factor array<double>"


@dataclass
class Summary:
    """Of some rows: how many, their mean, the sum of squared distances to it, and at most ``rank`` directions times their strengths."""

    n: int
    total: float
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, rank: int) -> Summary:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return cls(len(x), float(((x - mean) ** 2).sum()), mean, _cut(x - mean, rank))

    def merge(self, other: Summary, rank: int) -> Summary:
        """Of both together: the directions of both, and that between their means, cut to ``rank`` again."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        between = np.sqrt(self.n * other.n / n) * apart
        return Summary(n, self.total + other.total + float(between @ between), self.mean + apart * (other.n / n), _cut(np.vstack([self.factor, other.factor, between]), rank))

    def row(self, at: int) -> dict:
        return {"id": at, "n": self.n, "total": self.total, "mean": self.mean.tolist(), "factor": self.factor.ravel().tolist()}


def _cut(rows: np.ndarray, rank: int) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:rank, None] * v[:rank]


def _of_row(r, dim: int) -> Summary:
    return Summary(int(r["n"]), float(r["total"]), np.array(r["mean"], float), np.array(r["factor"], float).reshape(-1, dim))


class IncrementalPCA:
    """PCA over batches of vectors of one dimension, of which ``rank`` directions are kept between them.

    A task cuts its rows to ``rank`` directions, batch by batch; the tasks' summaries are merged in a tree, and one summary, rank times
    dimension numbers, reaches the driver for each batch. With ``rank`` equal to the dimension the result is exact; below it, what is cut
    away is what lies outside the strongest directions. A batch of any size counts, one row too; only ``components`` asks for as
    many rows as it gives components. Null vectors and those of another length are left out.
    """

    def __init__(self, dim: int, rank: int):
        if not 0 < rank <= dim:
            raise ValueError("0 < rank <= dim is required")
        self.dim, self.rank, self.known = dim, rank, Summary(0, 0.0, np.zeros(dim), np.zeros((0, dim)))

    def summary(self, rows: DataFrame, column: str = "embedding") -> DataFrame:
        """One row: the summary of ``rows``; none if there are none."""
        dim, rank = self.dim, self.rank

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            so_far, at = None, 0
            for b in batches:
                if len(b):
                    at, own = int(b["id"].iloc[0]), Summary.of(np.stack(b["v"].to_numpy()).astype(float), rank)
                    so_far = own if so_far is None else so_far.merge(own, rank)
            if so_far is not None:
                yield pd.DataFrame([so_far.row(at)])

        def merged(group: pd.DataFrame) -> pd.DataFrame:
            so_far = None
            for _, r in group.sort_values("id").iterrows():
                own = _of_row(r, dim)
                so_far = own if so_far is None else so_far.merge(own, rank)
            return pd.DataFrame([so_far.row(int(group["id"].min()))])

        v = F.col(column).cast("array<double>")
        parts = rows.where(F.coalesce(F.size(v) == dim, F.lit(False))).select(F.spark_partition_id().cast("long").alias("id"), v.alias("v")).mapInPandas(local, _ROW)
        for width in (FAN, FAN * FAN):
            parts = parts.withColumn("many", F.expr(f"id div {width}")).groupBy("many").applyInPandas(merged, _ROW)
        return parts.groupBy().applyInPandas(merged, _ROW)

    def update(self, batch: DataFrame, column: str = "embedding") -> IncrementalPCA:
        for r in self.summary(batch, column).collect():  # one row at most
            self.known = self.known.merge(_of_row(r, self.dim), self.rank)
        return self

    def components(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k components by row, their variances, their shares of all variance)."""
        if self.known.n < max(k, 2) or k > self.rank:
            raise ValueError(f"{k} components need {max(k, 2)} rows and a rank of {k}")
        _, s, v = np.linalg.svd(self.known.factor, full_matrices=False)
        variances = np.zeros(k)
        variances[: len(s)] = s[:k] ** 2 / (self.known.n - 1)
        return v[:k], variances, variances * (self.known.n - 1) / self.known.total if self.known.total else np.zeros(k)
