"""Sharding by a two-pass external shuffle.

First pass: every record goes to a bucket by a seeded hash of its contents, so a bucket is a uniform sample of the records
and, at ``bucket_bytes`` in the mean, fits in a task's memory. Second pass: each bucket is shuffled by itself with the
Fisher-Yates algorithm and written out. Buckets in a row are a uniform random order of all records; shards are runs of it,
with row counts at most one apart (the law ``rows``).

Equal records have equal hashes. So that a third of all rows being one record doesn't fill one bucket, equal rows are told apart
by a number among their equals. Records with equals meet once as one record with a count, by all their columns, which is
unfolded in runs of ``UNFOLDED`` over tasks; the others are scattered at once. Bucket sizes come from the hashes, so the records themselves are shuffled once and written once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, sieve

SHARDS = 8
SEED = 8191
BUCKET_BYTES = 8 << 20
#: Rows that a bucket may hold in the mean, however small they are.
BUCKET_ROWS = 20_000
#: Equal records that one task writes out.
UNFOLDED = 1000
#: Buckets whose rows are added up by one task.
BUCKETS_TOGETHER = 4096


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n): place i is swapped with a uniform place from i on."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = list(range(n))
    for i, j in enumerate(rng.integers(np.arange(n), n).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def _shuffle_buckets(seed: int):
    """Partitions sorted by bucket and key: each bucket's records in their order after the shuffle, with the place."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            order = fisher_yates(t.num_rows, xxhash.xxh64_intdigest(str(t["__tl_bucket"][0].as_py()).encode(), seed))
            held.clear()
            return t.take(pa.array(order)).append_column("__tl_place", pa.array(np.arange(len(order)), pa.int64())).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column("__tl_bucket").to_numpy()
            turn = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(turn[:-1].tolist(), turn[1:].tolist(), strict=True):
                if held and held[0].column("__tl_bucket")[0].as_py() != bucket[a]:
                    yield flush()
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _digest(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns of a row. Which of them are null counts, as Spark's hash passes over nulls; nested ones go as JSON that keeps them."""
    own = [F.col(f"`{f.name}`") for f in docs.schema]
    flat = [c if f.dataType.typeName() not in ("struct", "array", "map") else F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}) for c, f in zip(own, docs.schema, strict=True)]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in own])
    return F.xxhash64(F.lit(seed), nulls, *flat)


def _totals_before(sizes: DataFrame) -> DataFrame:
    """(__tl_bucket, n) to (__tl_bucket, __tl_before), the rows of all buckets before it, in two levels: groups of buckets, then each group's own."""
    grouped = sizes.withColumn("many", F.expr(f"__tl_bucket div {BUCKETS_TOGETHER}"))
    so_far = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    groups = grouped.groupBy("many").agg(F.sum("n").alias("n"))
    groups = groups.select("many", so_far(Window.orderBy("many")).alias("of_groups"))
    own = grouped.select("many", "__tl_bucket", so_far(Window.partitionBy("many").orderBy("__tl_bucket")).alias("of_own"))
    return own.join(groups, "many").select("__tl_bucket", (F.col("of_groups") + F.col("of_own")).alias("__tl_before"))


def _shuffled(docs: DataFrame, scratch: Scratch, n_shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """The records of ``docs`` through both passes, with __tl_bucket, __tl_shard and __tl_slot.

    Hashes only decide where a record goes. Which records are equal is decided by their columns, so none is ever taken for another.
    """
    key = ["__tl_key", "__tl_row"]
    keyed = docs.withColumns({"__tl_key": _digest(docs, seed), "__tl_row": _digest(docs, seed + 2)})
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    own = keyed.select(*key, size.alias("size")).groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    by_key = Window.partitionBy("__tl_key")  # more than one row only where hashes of different records are equal
    own = scratch.cut(own.withColumns({"first": F.sum("n").over(by_key.orderBy("__tl_row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "all": F.sum("n").over(by_key)}))
    rows, total = own.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_buckets = max(1, -(-int(total) // bucket_bytes), -(-rows // BUCKET_ROWS))
    # `nth` tells rows of one key apart, so that their number doesn't fill one bucket
    spread = F.xxhash64(F.lit(seed + 1), "__tl_key", "nth")
    bucket = F.pmod(spread, F.lit(n_buckets)).alias("__tl_bucket")
    run = lambda n: F.explode(F.expr(f"sequence(0L, ({n} - 1) div {UNFOLDED})"))
    nth = lambda n: F.explode(F.expr(f"sequence(first + run * {UNFOLDED}, first + least({n}, (run + 1) * {UNFOLDED}) - 1)"))
    once = own.where("n = 1").select("__tl_key", F.col("first").alias("nth"))
    often = own.where("n > 1").withColumn("run", run("n")).repartition(*key, "run").withColumn("nth", nth("n")).select("__tl_key", "nth")
    before = scratch.cut(_totals_before(once.unionByName(often).groupBy(bucket).agg(F.count("*").alias("n"))))
    keyed = in_sieve(keyed, "__tl_key", scratch.cut(sieve(own.where("all > 1"), "__tl_key")))
    alone = keyed.where("not __tl_in").select(*docs.columns, *key, F.lit(0).cast("long").alias("nth"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    met = keyed.where("__tl_in").groupBy(*columns, *key).agg(F.count("*").alias("__tl_n")).select(F.struct(*columns).alias("rec"), *key, "__tl_n")
    equals = met.join(own.select(*key, "first"), key).withColumn("run", run("__tl_n")).repartition(*key, "run").withColumn("nth", nth("__tl_n")).select("rec.*", *key, "nth")
    dealt = alone.unionByName(equals).select(*docs.columns, bucket, spread.alias("__tl_key"), "__tl_row").repartition("__tl_bucket").join(before, "__tl_bucket")
    dealt = dealt.sortWithinPartitions("__tl_bucket", "__tl_key", "__tl_row").drop("__tl_key", "__tl_row")
    schema = T.StructType([*dealt.schema.fields, T.StructField("__tl_place", T.LongType())])
    placed = dealt.mapInArrow(_shuffle_buckets(seed), schema).withColumn("__tl_at", F.col("__tl_before") + F.col("__tl_place"))
    return _place(placed, rows, n_shards).select(*docs.columns, "__tl_bucket", "__tl_shard", "__tl_slot")


def _place(at: DataFrame, rows: int, n_shards: int) -> DataFrame:
    """Adds __tl_shard and __tl_slot: runs of the order, the first ones a row longer if the rows don't divide evenly."""
    small, more = divmod(rows, n_shards)
    edge = more * (small + 1)
    number = F.expr(f"if(__tl_at < {edge}, __tl_at div {small + 1}, {more} + (__tl_at - {edge}) div {max(small, 1)})").cast("int")
    start = F.expr(f"if(__tl_shard < {more}, __tl_shard * {small + 1}, {edge} + (__tl_shard - {more}) * {small})")
    return at.withColumn("__tl_shard", number).withColumn("__tl_slot", (F.col("__tl_at") - start).cast("long"))


def shard(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('rows'), shard, slot, bucket, read from the written shards.

    Shards hold runs of the shuffled order, counts at most one apart; slots count from 0 without gaps. Null text has no
    bytes; size is UTF-8 bytes plus one; empty and very long texts are records like any other; equal rows are interchangeable
    and end at different places. An empty table gives an empty one. The order follows from the records and the seed.
    """
    scratch = Scratch(docs.sparkSession)
    out, path = _shuffled(docs, scratch, n_shards, seed, bucket_bytes), f"{scratch.root}/shards"
    out.sortWithinPartitions("__tl_shard", "__tl_slot").write.partitionBy("__tl_shard").parquet(path)
    back = docs.sparkSession.read.schema(out.schema).parquet(path)
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return back.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), F.col("__tl_shard").alias("shard"), F.col("__tl_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__tl_bucket").alias("bucket"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, str]:
    """Write all columns of ``docs`` as ``path``/shard=k, shuffled, with the slot in column ``slot``; the places are those of ``shard``.

    Returns the names of the two columns: if ``docs`` has one of that name, underscores are put before the new one's. Null
    texts, empty and very long ones, repeated rows and columns of any kind are records like others; an empty table gives no files.
    """
    names = []
    for name in ("shard", "slot"):
        while name.lower() in [c.lower() for c in docs.columns]:
            name = f"_{name}"
        names.append(name)
    out = _shuffled(docs, Scratch(docs.sparkSession), n_shards, seed, bucket_bytes)
    ordered = out.sortWithinPartitions("__tl_shard", "__tl_slot").select(*docs.columns, F.col("__tl_slot").alias(names[1]), F.col("__tl_shard").alias(names[0]))
    ordered.write.partitionBy(names[0]).parquet(path)
    return names[0], names[1]
