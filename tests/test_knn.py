"""The k-nearest-neighbour join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import knn, search
from trackloom.plans import agent
from trackloom.sinks.files import TrackWriter
from trackloom.sources import generators as gen


def brute(queries, index, k):
    x = np.array([v for _, v in index])
    out = []
    for q, v in queries:
        far = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
        out += [(q, i, n) for n, (_, i) in enumerate(sorted(zip(far.tolist(), [i for i, _ in index], strict=True))[:k], 1)]
    return sorted(out)


def found(spark, queries, index, k, kind="long", **options):
    q = spark.createDataFrame(queries, f"query_id {kind}, embedding array<double>")
    x = spark.createDataFrame(index, f"track_id {kind}, embedding array<double>")
    got = knn.knn_join(q, x, k, **options)
    return sorted(tuple(r) for r in got.select("query_id", "track_id", "rank").collect())


def clustered(n, centers, dim, rng):
    c = rng.normal(size=(centers, dim)) * 20
    return [(i, (c[i % centers] + rng.normal(size=dim)).tolist()) for i in range(n)]


def test_clusters_are_searched_in_few_cells(spark):
    rng = np.random.default_rng(1)
    index = clustered(2000, 12, 8, rng)
    queries = [(i, v) for i, v in index if i % 100 == 0] + [(-1, (rng.normal(size=8) * 20).tolist())]
    report = {}
    assert found(spark, queries, index, 7, report=report) == brute(queries, index, 7)
    assert report["queries"] == len(queries) and report["cells"] > 20
    assert report["visits"] < report["cells"] * report["queries"] / 3  # two thirds of the cells are passed over


def test_many_vectors_of_a_cell_and_many_queries_are_split(spark, monkeypatch):
    monkeypatch.setattr(knn, "TOGETHER", 50)
    monkeypatch.setattr(knn, "QUERIES", 9)
    rng = np.random.default_rng(2)
    index = clustered(600, 3, 4, rng) + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]  # a third are copies
    queries = [(i, v) for i, v in index if i % 10 == 0]
    nearest = knn._nearest

    def watched(k, dim, schema):
        run = nearest(k, dim, schema)
        return lambda q, p: run(q, p) if q.num_rows <= 40 and p.num_rows <= 120 else pytest.fail("a block is too large")

    monkeypatch.setattr(knn, "_nearest", watched)
    assert found(spark, queries, index, 5, pivots=3) == brute(queries, index, 5)


def test_edge_rows(spark):
    rnd = random.Random(4)
    index = [(i, [rnd.choice([0.0, 1.0]), rnd.choice([0.0, 1.0])]) for i in range(40)]
    queries = [(1, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [5.0, -7.0])]
    bad = [(100, None), (101, []), (102, [1.0]), (103, [float("nan"), 0.0]), (104, [float("inf"), 0.0]), (105, [None, 1.0]), (None, [0.0, 0.0])]
    for k in (1, 10, 40, 99):
        want = brute(queries, index, k)
        assert found(spark, [*queries, (9, None), (8, [1.0])], [*index, *bad], k) == want
    assert found(spark, [], index, 3) == [] and found(spark, queries, [], 3) == [] and found(spark, queries, bad[:2], 3) == []
    same = [("b", [3.0]), ("a", [3.0]), ("a", [3.0]), ("é", [3.0])]
    assert found(spark, [("q", [3.0])], same, 3, kind="string") == [("q", "a", 1), ("q", "a", 2), ("q", "b", 3)]


def test_pivots_lie_far_apart():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(200, 3)) * 0.1 + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9])])
    chosen = knn.spread_pivots(points, 4)
    assert min(np.linalg.norm(a - b) for i, a in enumerate(chosen) for b in chosen[:i]) > 8
    assert len(knn.spread_pivots(np.ones((5, 2)), 3)) == 1


def test_many_questions_have_the_answers_of_single_ones(spark, tmp_path):
    ids = spark.createDataFrame([(i, [float(i)] * 4, {"class_name": c, "color": "red"} if i % 3 else {"class_name": c}) for i, c in enumerate(["car", "person", "car", "bus", "tree", "car"])], "track_id long, embedding array<float>, metadata map<string,string>")
    index = search.VectorIndex(spark, f"{tmp_path}/ix")
    with pytest.raises(RuntimeError):
        index.search_many(spark.createDataFrame([(1, "car")], "query_id long, query string"))
    index.index_embeddings(ids)
    index.save()
    texts = {1: "car track_2", 2: "person", 3: "a red bus", 4: ""}
    asked = spark.createDataFrame(list(texts.items()), "query_id long, query string")
    for where in (None, {"class_name": "car"}, {"color": "red"}):
        many = index.search_many(asked, 3, where).collect()
        for q, text in texts.items():
            one = [(r["track_id"], round(r["distance"], 9), r["class_name"], r["metadata"]) for r in index.search(text, 3, where).collect()]
            assert sorted(map(str, one)) == sorted(str((r["track_id"], round(r["distance"], 9), r["class_name"], r["metadata"])) for r in many if r["query_id"] == q)
    with TrackWriter(spark, f"{tmp_path}/tracks") as w:
        w.write(gen.mock_tracks(spark, 5))
    a = agent.Agent(spark, f"{tmp_path}/ix", f"{tmp_path}/tracks")
    got = a.query_many(asked, 6)
    assert got.count() == 24 and got.where("found").select("track_id").distinct().count() == 2 and got.where("track_id = 1").agg(F.min(F.size("locations"))).first()[0] == 5
