import random
import zlib

import xxhash
from pyspark.sql import functions as F

from trackloom.llm import sharding


def check(df, rows, **options):
    got = sharding.shard(df, **options).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    n = [len(slots.get(k, [])) for k in range(sharding.SHARDS)]
    assert sum(n) == len(rows) and max(n) - min(n) <= 1 and set(slots) <= set(range(sharding.SHARDS))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    cols = lambda d: sorted(map(str, d.select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    assert cols(sharding.shard(df, **options)) == cols(sharding.shard(df.repartition(5), **options))
    return got


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(df, [tuple(r) for r in df.select("doc_id", "text").collect()], bucket_bytes=50_000)
    place = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    up = sum(a < b for a, b in zip(place, place[1:], strict=False))
    assert 70 < up < 130  # a random order rises at half of its 199 steps


def test_edge_rows(spark):
    rows = [(1, None), (1, ""), (2, "é" * 50_000), (None, "x"), (None, "x"), *[(5, "same")] * 40]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int")
    check(df, rows, bucket_bytes=20)
    assert sharding.shard(df.limit(0)).count() == 0
    check(df.where("doc_id = 2"), rows[2:3])


def test_written_shards(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(df, f"{tmp_path}/out", bucket_bytes=100_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in back.select("text").collect()) == sorted(r[0] for r in df.select("text").collect())
    per = back.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.count_distinct("slot").alias("d")).collect()
    assert len(per) == 8 and all(r["n"] == 25 == r["d"] == r["m"] + 1 for r in per)


def test_fisher_yates_is_a_uniform_permutation():
    seen = {}
    for seed in range(6000):
        p = tuple(sharding.fisher_yates(3, seed).tolist())
        seen[p] = seen.get(p, 0) + 1
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())


def test_reported_places_are_those_of_the_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    same = spark.createDataFrame([(7, "equal", "a")] * 2500 + [(7, "equal", "b")] * 500, docs.schema)
    df = docs.unionByName(same)
    sharding.write_shards(df, f"{tmp_path}/out", bucket_bytes=20_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select("doc_id", "text", "source").collect())) == sorted(map(str, df.collect()))
    got = sharding.shard(df, bucket_bytes=20_000)
    places = lambda d: sorted(map(tuple, d.select("shard", "slot", "doc_id", "text_crc32").collect()))
    assert places(got) == places(back.withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))))
    per = got.groupBy("bucket").count().collect()
    assert len(per) > 20 and max(r["count"] for r in per) < 600  # equal rows don't fill one bucket


def test_order_by_hand(spark, sf):
    """Hashed buckets, Fisher-Yates in each, the buckets one after the other, cut into runs: from the keys alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    nth = F.lit(0).cast("long")
    key = sharding._digest(docs, sharding.SEED)
    rows = docs.select("doc_id", (F.octet_length("text") + 1).alias("size"), F.xxhash64(F.lit(sharding.SEED + 1), key, nth).alias("spread")).collect()
    n_buckets = max(1, -(-sum(r["size"] for r in rows) // 30_000))
    order = []
    for b in range(n_buckets):
        own = [r["doc_id"] for r in sorted(rows, key=lambda r: r["spread"]) if r["spread"] % n_buckets == b]
        turn = sharding.fisher_yates(len(own), xxhash.xxh64_intdigest(str(b).encode(), sharding.SEED))
        order += [own[i] for i in turn]
    small, more = divmod(len(order), sharding.SHARDS)
    want, at = {}, 0
    for k in range(sharding.SHARDS):
        for slot in range(small + (k < more)):
            want[order[at]] = (k, slot)
            at += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, bucket_bytes=30_000).collect()} == want


def test_written_shards_of_edge_rows(spark, tmp_path):
    rows = [(1, None, 9, {"a": 1}), (1, "", 9, None), (2, "é" * 3000, None, {}), *[(5, "same", 1, {"b": 2})] * 30, (None, "x", 2, {"c": None})]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, tags map<string,int>").withColumn("slot", F.lit("own"))
    names = sharding.write_shards(df, f"{tmp_path}/out", bucket_bytes=50)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert names == ("_shard", "_slot") and sorted(back.columns) == sorted([*df.columns, *names])
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    per = back.groupBy("_shard").agg(F.count("*").alias("n"), F.count_distinct("_slot").alias("d"), F.max("_slot").alias("m")).collect()
    assert len(per) == 8 and all(r["d"] == r["n"] == r["m"] + 1 and r["n"] in (4, 5) for r in per)
    assert sharding.shard(df).count() == len(rows)
    sharding.write_shards(df.limit(0), f"{tmp_path}/none")


def test_records_that_differ_only_by_which_column_is_null(spark, tmp_path):
    rnd = random.Random(9)
    some = lambda *x: rnd.choice([None, *x])
    rows = [(1, "same", "en", None, None, None), (1, "same", None, "en", None, None), (1, "same", None, None, ("a", None), ["x", None]), (1, "same", None, None, (None, "a"), [None, "x"]), (1, "same", None, None, ("a", None), ["x", None])]
    rows += [(some(1, 2), some("", "t"), some("a", "b"), some("a", "b"), rnd.choice([None, (None, None), ("a", None), (None, "a")]), rnd.choice([None, [], [None], ["a"], ["a", None]])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, pair struct<l:string,r:string>, list array<string>")
    sharding.write_shards(df.repartition(6), f"{tmp_path}/out", bucket_bytes=500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(repr, back.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    per = back.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(per) == 8 and all(r["n"] == r["d"] == r["m"] + 1 for r in per) and max(r["n"] for r in per) - min(r["n"] for r in per) <= 1


def test_equal_hashes_lose_nothing(spark, tmp_path, monkeypatch):
    """All records with one hash: they still come out as they went in."""
    monkeypatch.setattr(sharding, "_digest", lambda docs, seed: F.lit(seed).cast("long") + F.length("text") * 0)
    rows = [(i % 7, "ab"[i % 2], f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(df, f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*df.columns).collect())) == sorted(rows)


def test_totals_before_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS_TOGETHER", 7)
    rnd = random.Random(2)
    sizes = {b: rnd.randint(1, 9) for b in rnd.sample(range(200), 90)}
    got = sharding._totals_before(spark.createDataFrame(list(sizes.items()), "__tl_bucket long, n long")).collect()
    assert {r[0]: r[1] for r in got} == {b: sum(n for x, n in sizes.items() if x < b) for b in sizes}
