import numpy as np
import pytest

from trackloom.llm import ann


def brute(rows, asked, top):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q in asked:
            s = sorted(((-float((x * v).sum()), i) for i, x in ok if i != q))[:top]
            out[q] = [i for _, i in s]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64)) + 2 * rng.normal(size=(20, 64))[rng.integers(20, size=3000)]
    x = (x * rng.uniform(0.5, 2, (3000, 1))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), block=500, rerank=12).toPandas()
    want = brute([(i, v) for i, v in enumerate(x)], set(range(0, 3000, 20)), 20)
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (150 * 20) >= 0.9
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        s = [(float((x[i].astype(float) * x[q].astype(float)).sum())) for i in g["vec_id"]]
        assert np.allclose(g["score"], s, rtol=1e-12) and sorted(zip([-a for a in g["score"]], g["vec_id"], strict=True)) == list(zip([-a for a in g["score"]], g["vec_id"], strict=True))


def test_recall_of_the_query_over_several_blocks(spark):
    """Unclustered unit vectors, the query's own parameters but for smaller blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), block=1500).toPandas()
    want = brute([(i, v) for i, v in enumerate(x)], set(range(0, 6000, 20)), 20)
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.97 * 300 * 20


@pytest.mark.parametrize("kind", ["tight heaps", "tight heaps of many sizes", "far apart norms"])
def test_recall_where_codes_of_whole_vectors_tell_too_little(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    heaps = rng.normal(size=(14, 64))[np.arange(6000) % 14]
    if kind == "far apart norms":
        x = x * np.exp(2.5 * rng.normal(size=(6000, 1)))
    else:
        x = heaps + (1e-3 if kind == "tight heaps" else np.exp(-8 * rng.random((6000, 1)))) * x
    x = x.astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), block=3000).toPandas()
    want = brute([(i, v) for i, v in enumerate(x)], set(range(0, 6000, 20)), 20)
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id")) >= 0.99 * 300 * 20


def test_only_codes_and_numbers_are_dealt_for_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = ann.search(df, df.where("vec_id % 20 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_anisotropic_codes_keep_scores_better_than_plain_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x)
    near = lambda b: np.concatenate([c[b.encode(x)[:, j]] for j, c in enumerate(b.centres)], axis=1)
    along = lambda y: np.mean(((x - y) * x).sum(axis=1) ** 2)
    plain = ann.fit(x)
    plain.eta = 1.0
    books.eta = 5.0
    assert along(near(books)) < along(near(plain))


def test_ties_copies_and_edge_rows(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)] + [(60, [0.5, 1.0, 0.0]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0, nan, 0.0]), (64, [1.0, None, 0.0]), (65, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (80, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = ann.search(df, df.where("vec_id % 20 = 0"), top=5)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by == brute([r for r in rows if r[1] is None or len(r[1]) == 3], {0, 20, 40, 60, 80}, 5)
    few = ann.search(df.where("vec_id in (60, 80)"), df.where("vec_id = 60")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(60, 1, 80, 1.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
