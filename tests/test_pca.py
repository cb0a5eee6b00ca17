"""Incremental PCA against the whole decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.streaming import frames as streams
from trackloom.streaming.pca import IncrementalPCA, Summary


def exact(x, k):
    c = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    return v[:k], s[:k] ** 2 / (len(x) - 1), (c**2).sum()


def angle(a, b):
    """The largest angle between two subspaces, in degrees."""
    return np.degrees(np.arccos(np.clip(np.linalg.svd(a @ b.T)[1].min(), -1, 1)))


def low_rank(n, dim, rng):
    return rng.normal(size=(n, 5)) * [9, 7, 5, 4, 3] @ np.linalg.qr(rng.normal(size=(dim, 5)))[0].T + rng.normal(size=(n, dim)) * 0.1 + 3


def table(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")


def test_summaries_merge_to_the_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5] + 7
    parts = [Summary.of(p, 6) for p in np.split(x, [1, 2, 50, 51, 130])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p, 6)
    assert whole.n == 200 and np.allclose(whole.mean, x.mean(axis=0))
    c = x - x.mean(axis=0)
    assert np.allclose(whole.factor.T @ whole.factor, c.T @ c) and np.isclose(whole.total, (c**2).sum())


def test_few_directions_are_enough_for_rows_of_low_rank(spark):
    rng = np.random.default_rng(2)
    x = low_rank(900, 24, rng)
    pca = IncrementalPCA(24, 8)
    for part in np.split(x, [3, 300, 301]):  # batches of fewer rows than components too
        pca.update(table(spark, part).repartition(3))
    v, variances, shares = pca.components(5)
    want, wanted, total = exact(x, 5)
    assert angle(v, want) < 0.5 and np.allclose(variances, wanted, rtol=1e-3)
    assert np.allclose(shares, wanted * 899 / total, rtol=1e-3) and pca.known.factor.shape == (8, 24)


def test_full_rank_is_exact_however_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 7)) @ rng.normal(size=(7, 7))
    want, wanted, _ = exact(x, 7)
    for n in (1, 9):
        v, variances, _ = IncrementalPCA(7, 7).update(table(spark, x).repartition(n)).components(7)
        assert np.allclose(variances, wanted) and np.allclose(np.abs((v * want).sum(axis=1)), 1)


def test_short_batches_and_bad_rows(spark):
    pca = IncrementalPCA(3, 2)
    with pytest.raises(ValueError):
        pca.components(1)
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,), ([1.0],), ([2.0, 2.0, 3.0],)], "embedding array<double>")
    pca.update(rows.limit(0)).update(rows)
    assert pca.known.n == 2 and np.allclose(pca.components(1)[0], [[1, 0, 0]]) or np.allclose(pca.components(1)[0], [[-1, 0, 0]])
    with pytest.raises(ValueError):
        pca.components(3)
    with pytest.raises(ValueError):
        IncrementalPCA(3, 4)


def test_failed_batches_are_kept(spark, tmp_path):
    for i in range(4):
        spark.range(i, i + 1).write.mode("append").parquet(f"{tmp_path}/in")

    def process(batch, epoch):
        if batch.where("id % 2 = 1").count():
            raise ValueError("odd")

    f = streams.read_frames(spark, f"{tmp_path}/in", "id long", 1)
    q, state = streams.run_guarded(f, process, f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert state["errors"] == 2 == len(state["failed"])
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/checkpoint-failed").select("id").where(F.col("id") % 2 == 1).collect()) == [1, 3]
