"""Radius graphs of dense cubes against brute force."""

import random

import numpy as np
import pytest

from trackloom.operators import dense, graph


def brute(rows, radius, cap, loop=False):
    out = []
    for g in {r[0] for r in rows}:
        own = [(i, np.array(p)) for h, i, *p in rows if h == g and None not in p]
        x = np.array([p for _, p in own])
        for i, p in own:
            d = x - p
            far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            near = sorted((float(f), j) for f, (j, _) in zip(far, own, strict=True) if f < radius and (loop or j != i))
            out += [(g, i, j) for _, j in near[:cap]]
    return sorted(out)


def edges(spark, rows, radius, cap, **options):
    df = spark.createDataFrame(rows, "graph_id long, node_idx long, px double, py double, pz double")
    return sorted(tuple(r)[:3] for r in graph.radius_edges(df, radius, cap, **options).select("graph_id", "src", "dst").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_and_sparse_cubes_meet(spark, monkeypatch, seed):
    monkeypatch.setattr(dense, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    heaps = [rng.normal(size=(130, 3)) * s + c for s, c in ((0.05, [0.5, 0.5, 0.5]), (0.3, [1.0, 1.0, 1.0]), (0.4, [-0.2, 0.1, 0.9]))]
    x = np.concatenate([*heaps, rng.uniform(-2, 3, (120, 3)), np.zeros((25, 3)), np.full((25, 3), 1.0)])  # places that many share, on corners too
    rows = [(i % 2, i, *map(float, p)) for i, p in enumerate(x)] + [(0, 9000, None, 0.0, 0.0), (1, 9001, 5.0, 5.0, 5.0)]
    random.Random(seed).shuffle(rows)
    for radius, cap in ((1.0, 5), (1.0, 40), (0.25, 3), (1.0, 1)):
        assert edges(spark, rows, radius, cap, dense=20) == brute(rows, radius, cap)
    assert edges(spark, rows, 1.0, 6, dense=20, loop=True) == brute(rows, 1.0, 6, True)
    assert edges(spark, rows, 1.0, 6, dense=None) == brute(rows, 1.0, 6)


def test_a_hundred_thousand_points_in_one_cube(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 0.999, (100_000, 3))
    x[:3000] = x[0] + rng.normal(size=(3000, 3)) * 1e-6  # some of them in a tight heap
    x = np.clip(x, 0, 0.999)
    df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(x.tolist())], "graph_id long, node_idx long, px double, py double, pz double").repartition(8)
    got = graph.radius_edges(df, 1.0, 32)
    by = {}
    for src, dst in got.where("src % 499 = 0 or src = 5").select("src", "dst").collect():
        by.setdefault(src, set()).add(dst)
    assert len(by) == 202
    for i, found in by.items():
        d = x - x[i]
        far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        far[i] = np.inf
        assert found == set(np.lexsort((np.arange(len(x)), far))[:32].tolist())


@pytest.mark.parametrize("name", ["radius_edges", "radius_edges_capped", "node_degree"])
def test_cubes_and_their_neighbours_are_never_broadcast(spark, sf, name):
    """The exploded side is 14 times what Spark takes it for."""
    from trackloom import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
