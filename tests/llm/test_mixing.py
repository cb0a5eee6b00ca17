import re

import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full, out = 1.5 * sum(size.values()), set(), {}
    while True:
        rest, w = total - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        out = {s: 2.0 * size[s] if s in full else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in full and out[s] > 2 * size[s]}
        if not more:
            return out
        full |= more


def check(df, rows, **options):
    got = mixing.mix(df, **options).collect()
    size, taken = {}, {}
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, words(t)) for d, t, _ in rows if d is not None)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = brute_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), **options).collect()))
    return got


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    got = check(df, rows, block_words=500)
    assert len({r["shard_1"] for r in got} - {None}) > 8
    mixed = mixing.mixed_rows(df, block_words=500)
    assert mixed.columns == df.columns and sum(words(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_edge_rows(spark):
    rows = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (3, "x y", "s"), (3, "x y", "s"), (None, "p q r s t", "é"), (7, "w " * 5000, "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, sid int")
    check(df, rows)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).first()["taken"] == 0


def test_tree_keeps_quotas_and_mixes(spark):
    q = spark.createDataFrame([(0, 4000), (1, 1000), (2, 3)], "sid int, q long")
    got = mixing.split_quotas(q, 7, 5).collect()
    for sid, n in ((0, 4000), (1, 1000), (2, 3)):
        assert sum(r["q"] for r in got if r["sid"] == sid) == n
    per = {s: {r["sid"]: r["q"] for r in got if r["shard"] == s} for s in range(7)}
    assert all(abs(sum(p.values()) - 5003 / 7) <= 3 for p in per.values())
    assert all(90 < p[1] < 200 for p in per.values())  # hypergeometric: mean 143, deviation 10


def test_plan_has_no_python(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").withColumn("z", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_partitions_of_the_rows_are_the_shards(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    want = sorted((r["doc_id"], s) for r in mixing.mix(df, block_words=500).collect() for s in (r["shard_1"], r["shard_2"]) if s is not None)
    for part_words in (mixing.PART_WORDS, 3000):
        monkeypatch.setattr(mixing, "PART_WORDS", part_words)
        rows = mixing.mixed_rows(df, block_words=500)
        parts = rows.rdd.getNumPartitions() // mixing.SHARDS
        at = rows.select("doc_id", "source", F.spark_partition_id().alias("at")).collect()
        assert sorted((r["doc_id"], r["at"] // parts) for r in at) == want
        big = [r["source"] for r in at if r["at"] == 0]
        assert part_words < 10_000 or sum(a != b for a, b in zip(big, big[1:], strict=False)) > len(set(big))  # not source after source


def test_more_passes_where_the_ceiling_asks_for_them(spark):
    rows = [(i, "a b c d", s) for i in range(10) for s in ("x", "y")] + [(99, "e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for ceiling, share in ((3.0, 3.0), (3.5, 3.2), (1.0, 0.7), (0.5, 0.4)):
        got = mixing.mix(df, ceiling=ceiling, share=share, block_words=7).collect()
        for s in ("x", "y"):
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= max(1, -(-ceiling // 1)) * r["size"] for r in got)
        mixed = mixing.mixed_rows(df, ceiling=ceiling, share=share, block_words=7).collect()
        assert sum(words(r["text"]) for r in mixed) == sum(r["taken"] for r in got)


def test_mixed_rows_of_edge_rows(spark):
    rows = [(1, "a b c", None, 5), (2, None, "s", 6), (3, "", "s", 7), (4, "x y", "s", 8), (4, "x y", "s", 8), (None, "p q r s t", "t", None), (7, "w " * 3000, "t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = mixing.mixed_rows(df, "mix_shard", block_words=50)
    taken = sorted((str(r["doc_id"]), r["text"]) for r in got.collect())
    assert got.columns == [*df.columns, "mix_shard"] and not {"2", "3"} & {d for d, _ in taken}
    assert sum(words(t) for _, t in taken) == sum(r["taken"] for r in mixing.mix(df, block_words=50).collect())
    assert {r["mix_shard"] for r in got.collect()} <= set(range(mixing.SHARDS)) and all(r["shard"] in (5, 6, 7, 8, 9, None) for r in got.collect())
    places = {(r["doc_id"], r["mix_shard"]) for r in got.collect()}
    assert places == {(r["doc_id"], s) for r in mixing.mix(df, block_words=50).collect() for s in (r["shard_1"], r["shard_2"]) if s is not None}
    assert mixing.mixed_rows(df.limit(0)).count() == 0 and mixing.mixed_rows(df.where("doc_id = 3")).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed_rows(df, "shard")
