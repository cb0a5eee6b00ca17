"""What the training-data operators share: scratch tables, table reading, components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are neither a space nor \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"
#: Rows with whole texts or sets that are handed to Python at a time; every row is handed over.
TEXTS_TOGETHER = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset.

    A warehouse on a machine's own disk will do for a local master alone; on a cluster it is refused.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    root = spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    own = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getScheme() == "file"
    if own and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{root} is a folder of one machine: set spark.checkpoint.dir to one that all executors share")
    return root.rstrip("/")


_roots: list[str] = []


def scratch_mark() -> int:
    """How many scratch folders this process has: what is made from now on can be cleared by this mark."""
    return len(_roots)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete this process's scratch tables, or those made since a mark; results that still read them must have been written before."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while len(_roots) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/trackloom-{uuid.uuid4().hex}"
        self.n = 0
        _roots.append(self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS_TOGETHER) -> Iterator[None]:
    """What is run (not only planned) within hands Python at most so many rows at a time; afterwards the session's own limit holds again.

    A batch of whole texts stands in the executor's native memory and in the worker's at once, in buffers of up to twice its
    size, and both keep what they had; results don't depend on batches.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, own)


SIEVE_BITS = 1 << 27


def sieve(rows: DataFrame, key: str) -> DataFrame:
    """A bitmap of the longs in ``key``, in pieces of 4 KB, 16 MB at most: a broadcast instead of a shuffle of what isn't in it."""
    bit = f"pmod({key}, {SIEVE_BITS}L) + 1"
    return rows.groupBy(F.expr(f"bitmap_bucket_number({bit})").alias("__tl_piece")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({bit}))").alias("__tl_bits"))


def in_sieve(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``rows`` with __tl_in: false for no key of the sieve, true for few others; an exact join must follow."""
    bit = f"pmod({key}, {SIEVE_BITS}L) + 1"
    at = f"bitmap_bit_position({bit})"
    test = F.coalesce(F.expr(f"getbit(cast(conv(hex(substring(__tl_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) = 1"), F.lit(False))
    return rows.withColumn("__tl_piece", F.expr(f"bitmap_bucket_number({bit})")).join(F.broadcast(bits), "__tl_piece", "left").withColumn("__tl_in", test).drop("__tl_piece", "__tl_bits")


def open_nodes(edges: DataFrame) -> int:
    """Of distinct edges (u > v): how many nodes have several smaller neighbours, or a smaller and a larger one. Of stars, none."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")
    return edges.select(ends).groupBy("x.node").agg((F.sum("x.up") + F.max("x.down")).alias("n"), F.max("x.up").alias("up")).agg(F.count_if((F.col("n") > 1) & (F.col("up") == 1))).first()[0]


def star_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (long) as ``(u, root)``, root being the component's smallest node.

    Alternating large-star and small-star: each round is two aggregations with map-side combine and two joins on
    edge-sized tables, and the number of rounds grows with the logarithm of the component's size. The rounds end with the
    first edges that are stars, so edges that are stars already need none. One number a round reaches the driver. Nodes that
    stand in no edge are not returned.
    """
    e = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if not open_nodes(e):
            return e.select("u", F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins' sides are plain shuffles and the rows of a node with very many neighbours can be split
        least = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.cut(large)
        least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = scratch.cut(small)
        scratch.drop(e)
        e = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
