"""The cache as a log that sessions share."""

import random

from pyspark.sql import functions as F

from trackloom.operators import cache
from trackloom.operators.cache import CacheLog, DepthCache, cache_state
from trackloom.schemas import CACHE_LOG


def depth(spark, n):
    return spark.range(n).select(F.lit(1).cast("long").alias("frame_idx"), F.lit(0).alias("v"), F.col("id").cast("int").alias("u"), F.lit(2.0).cast("float").alias("z"))


def replay(records):
    """Entries by going through the records in order."""
    there, used = {}, {}
    for key, op, size, at, writer, seq, data in sorted(records, key=lambda r: (r[3], r[4], r[5])):
        if op == "put":
            there[key] = (size, data)
        elif op == "evict":
            there.pop(key, None)
        if op != "evict":
            used[key] = at
    return sorted((k, size, used[k], data) for k, (size, data) in there.items())


def rows(df):
    return sorted(map(tuple, df.select("key", "bytes", "last_used", "data").collect()))


def random_records(n, seed):
    rnd = random.Random(seed)
    return [(f"k{rnd.randint(0, 9)}", rnd.choice(["put", "put", "touch", "touch", "evict"]), rnd.randint(1, 99), rnd.randint(1, 40), rnd.choice("ab"), i, f"d{i}") for i in range(n)]


def test_state_is_that_of_a_replay(spark):
    for seed in range(4):
        records = random_records(60, seed)
        df = spark.createDataFrame(records, CACHE_LOG)
        assert rows(cache_state(df)) == replay(records)
        assert rows(cache_state(df.unionByName(df))) == replay(records)  # a record that was written twice counts once
        assert rows(cache_state(cache.last_records(df, 0))) == replay(records)
    assert rows(cache_state(df.limit(0))) == []


def test_compaction_between_appends_of_two_sessions(spark, tmp_path):
    records = random_records(80, 9)
    sessions = [CacheLog(spark, str(tmp_path), 1 << 62), CacheLog(spark.newSession(), str(tmp_path), 1 << 62)]
    for i in range(0, 80, 10):
        sessions[i // 10 % 2].append(records[i : i + 10])
        if i % 30 == 20:
            sessions[(i // 30) % 2].compact()
        assert rows(sessions[0].state()) == rows(sessions[1].state()) == replay(records[: i + 10])
    sessions[0].compact()
    sessions[1].compact()
    assert rows(CacheLog(spark, str(tmp_path)).state()) == replay(records) and sessions[0].folders() == 0
    assert len(list((tmp_path / "snapshots").iterdir())) <= 2 and not list((tmp_path / "log").iterdir())


def test_a_snapshot_that_was_not_finished_does_not_count(spark, tmp_path):
    log = CacheLog(spark, str(tmp_path), 1 << 62)
    records = random_records(20, 3)
    log.append(records)
    log.compact()
    (tmp_path / "snapshots" / next((tmp_path / "snapshots").iterdir()).name / "done").unlink()
    assert rows(log.state()) == replay(records)
    log.compact()
    assert rows(log.state()) == replay(records)


def test_recency_outlives_a_session_and_is_shared(spark, tmp_path):
    first = DepthCache(spark, f"{tmp_path}/c")
    for k in "abc":
        first.put(k, depth(spark, 50))
    size = first.stats()["gb"] * 2**30 / 3
    DepthCache(spark, f"{tmp_path}/c").get("a")  # another session touches it
    third = DepthCache(spark.newSession(), f"{tmp_path}/c", int(size * 3.5))
    third.put("d", depth(spark, 50))
    assert not first.exists("b") and first.exists("a") and first.exists("c") and first.get("d").count() == 50
    first.put("a", depth(spark, 70))
    assert third.get("a").count() == 70 and third.stats()["entries"] == 3
    assert len([p for p in (tmp_path / "c" / "data").iterdir()]) == 3  # evicted and replaced data is gone
    third.clear()
    assert first.stats()["entries"] == 0 and not list((tmp_path / "c" / "data").iterdir())


def test_the_log_is_compacted_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "COMPACT_AT", 3)
    c = DepthCache(spark, f"{tmp_path}/c")
    c.put("a", depth(spark, 3))
    for _ in range(7):
        c.get("a")
    assert c.log.folders() <= 4 and c.stats()["entries"] == 1 and list((tmp_path / "c" / "snapshots").iterdir())


def test_old_evictions_are_forgotten(spark):
    df = spark.createDataFrame([("a", "evict", None, 5, "w", 1, None), ("b", "evict", None, 50, "w", 2, None), ("c", "put", 1, 3, "w", 3, "d")], CACHE_LOG)
    assert sorted(r["key"] for r in cache.last_records(df, 20).collect()) == ["b", "c"]
