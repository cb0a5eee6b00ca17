"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks. DataFrame operations only.

Every source is dealt into blocks of about ``block_words`` words by a seeded hash, so a block is a random draw from its
source and a source of any share of the rows becomes many blocks. A source whose target is r times its size is walked
through r times in its permuted block order (``ceiling`` bounds r): whole passes take every block, the last pass takes blocks until the target
is met, and the block at the edge is taken document by document, the document at the edge word by word.

The drawn blocks of each source are its exact quota. A binary tree splits the quotas among the output shards: at a node,
the left half's slots are filled from the node's blocks without replacement, so the counts by source follow the
multivariate hypergeometric law, and every shard mixes the sources as the whole does. Each shard then receives disjoint
runs of each source's permuted blocks, and only what lies within a shard's block is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2.0
#: Words of a block, more where there would be over MAX_BLOCKS of them.
BLOCK_WORDS, MAX_BLOCKS = 1 << 17, 1 << 20
SHARDS = 16
#: Words of a shard that one task gathers.
PART_WORDS = 1 << 22
SEED = 20240229


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) -> sid, weight, source_size, target.

    The targets share ``share`` of the total by weight; none exceeds ``ceiling`` times its source's size, and what is cut
    off is shared by weight among the rest. That is one water level: with sources in order of ceiling / weight, the level
    after the first k sources are full is (total - their ceilings) / (the other weights), and its largest value holds.
    The table has a row for each source, so its windows are as small as the list of sources.
    """
    sid = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("sid")
    s = sizes.select("source", "source_size", sid)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - before) / rest)
    level = F.max("level").over(Window.partitionBy())
    return s.select("source", "sid", "weight", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """(sid, q) -> (shard, sid, q): the splitting tree.

    A node holds its exact quota of each source. Its left child's floor(total * shards / shards) slots are drawn from the
    node's blocks without replacement, by selection sampling: block after block, one is taken with probability
    (slots left) / (blocks left). Shard totals differ by at most one for each level.
    """
    node = quotas.agg(F.sum("q").alias("total"), F.array_sort(F.collect_list(F.struct("sid", "q"))).alias("arr")).select(F.lit(0).alias("lo"), F.lit(n_shards).alias("n"), "total", "arr").where("total is not null")
    uniform = f"cast(pmod(xxhash64({seed}, lo, n, s.sid, i), 9007199254740992L) as double) / 9007199254740992D"
    draw = (
        "aggregate(if(s.q > 0, sequence(1L, s.q), cast(array() as array<bigint>)), named_struct('l', a.l, 'p', a.p, 'g', 0L), "
        f"(b, i) -> if({uniform} * b.p < b.l, named_struct('l', b.l - 1, 'p', b.p - 1, 'g', b.g + 1), named_struct('l', b.l, 'p', b.p - 1, 'g', b.g)))"
    )
    taken = (
        "aggregate(arr, named_struct('l', slots, 'p', total, 'out', cast(array() as array<bigint>)), "
        f"(a, s) -> transform(array({draw}), x -> named_struct('l', x.l, 'p', x.p, 'out', concat(a.out, array(x.g))))[0]).out"
    )
    levels = (n_shards - 1).bit_length()
    for _ in range(levels):
        node = node.withColumn("half", F.expr("n div 2").cast("int")).withColumn("slots", F.expr("total * half div n")).withColumn("left", F.expr(taken))
        left = "named_struct('lo', lo, 'n', half, 'total', slots, 'arr', zip_with(arr, left, (s, g) -> named_struct('sid', s.sid, 'q', g)))"
        right = "named_struct('lo', lo + half, 'n', n - half, 'total', total - slots, 'arr', zip_with(arr, left, (s, g) -> named_struct('sid', s.sid, 'q', s.q - g)))"
        node = node.select(F.expr(f"inline(array({left}, {right}))")).where("n > 0")
    return node.select(F.col("lo").alias("shard"), F.explode("arr").alias("s")).select("shard", "s.sid", "s.q").where("q > 0")


def with_keys(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds __tl_size (words) and __tl_key (seeded hash of doc_id, source and text)."""
    return docs.withColumns({"__tl_size": n_words(), "__tl_key": F.xxhash64(F.lit(seed), "doc_id", "source", "text")})


class Mix:
    """A plan for ``keyed`` rows (source, __tl_size, __tl_key and any others), kept in three small tables."""

    def __init__(self, keyed: DataFrame, scratch: Scratch, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED, **rule):
        self.passes = range(1, max(1, math.ceil(rule.get("ceiling", CEILING))) + 1)
        self.sources = scratch.cut(
            targets(keyed.groupBy("source").agg(F.sum("__tl_size").alias("source_size")), **rule).withColumns({"n_blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(block_words)), F.sum("source_size").over(Window.partitionBy()) / MAX_BLOCKS))), "quota": F.floor(F.col("target") + 0.5)})
        )
        sizes = self._dealt(keyed.where("__tl_size > 0").select("source", "__tl_size", "__tl_key")).groupBy("__tl_sid", "__tl_block").agg(F.sum("__tl_size").alias("size"))
        permuted = Window.partitionBy("__tl_sid").orderBy(F.xxhash64(F.lit(seed), "__tl_sid", "__tl_block"), "__tl_block")
        at = F.sum("size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        placed = sizes.join(self.sources.select(F.col("sid").alias("__tl_sid"), "source_size", "quota"), "__tl_sid").withColumn("at", at)
        clamp = lambda x: F.greatest(F.lit(0), F.least("size", x))
        blocks = scratch.cut(placed.withColumns({f"take_{p}": clamp(F.col("quota") - (p - 1) * F.col("source_size") - F.col("at")) for p in self.passes}))
        drawn = blocks.select("__tl_sid", "__tl_block", F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"take_{p}").alias("take")) for p in self.passes])).alias("d")).where("d.take > 0").select("__tl_sid", "__tl_block", "d.pass")
        rank = F.row_number().over(Window.partitionBy("__tl_sid").orderBy(F.xxhash64(F.lit(seed + 1), "__tl_sid", "pass", "__tl_block"), "pass", "__tl_block"))
        quotas = split_quotas(drawn.groupBy(F.col("__tl_sid").alias("sid")).agg(F.count("*").alias("q")), shards, seed)
        end = F.sum("q").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
        runs = quotas.withColumn("end", end).select("shard", F.col("sid").alias("__tl_sid"), F.explode(F.sequence(F.col("end") - F.col("q") + 1, F.col("end"))).alias("rank"))
        dealt = drawn.withColumn("rank", rank.cast("long")).join(runs, ["__tl_sid", "rank"])
        shard = dealt.groupBy("__tl_sid", "__tl_block").agg(*[F.max(F.when(F.col("pass") == p, F.col("shard"))).alias(f"__tl_shard_{p}") for p in self.passes])
        edge = " or ".join(f"take_{p} > 0 and take_{p} < size" for p in self.passes)
        self.blocks = scratch.cut(blocks.join(shard, ["__tl_sid", "__tl_block"], "left").select("__tl_sid", "__tl_block", "at", *self._each("take"), *self._each("__tl_shard"), F.expr(edge).alias("edge")))

    def _each(self, name: str) -> list[str]:
        return [f"{name}_{p}" for p in self.passes]

    def _dealt(self, keyed: DataFrame) -> DataFrame:
        s = self.sources.select(F.col("source").alias("__tl_source"), F.col("sid").alias("__tl_sid"), "n_blocks", F.col("source_size").alias("__tl_source_size"), F.col("target").alias("__tl_target"), F.col("quota").alias("__tl_quota"))
        return keyed.join(s, keyed["source"].eqNullSafe(s["__tl_source"])).withColumn("__tl_block", F.expr("pmod(__tl_key, n_blocks)")).drop("__tl_source", "n_blocks")

    def apply(self, keyed: DataFrame) -> DataFrame:
        """``keyed`` with __tl_source_size, __tl_target, and for each pass p __tl_take_p (words taken) and __tl_shard_p."""
        b = self.blocks
        joined = self._dealt(keyed).join(b, ["__tl_sid", "__tl_block"], "left")
        whole = joined.where("__tl_size = 0 or edge is null or not edge").withColumns({f"__tl_take_{p}": F.when(F.col(f"take_{p}") > 0, F.col("__tl_size")).otherwise(F.lit(0)).cast("long") for p in self.passes})
        order = Window.partitionBy("__tl_sid", "__tl_block").orderBy("__tl_key", "__tl_size").rowsBetween(Window.unboundedPreceding, 0)
        off = F.col("at") + F.sum("__tl_size").over(order) - F.col("__tl_size")
        clamp = lambda x: F.greatest(F.lit(0), F.least("__tl_size", x)).cast("long")
        edge = joined.where("__tl_size > 0 and edge").withColumn("__tl_off", off).withColumns({f"__tl_take_{p}": clamp(F.col("__tl_quota") - (p - 1) * F.col("__tl_source_size") - F.col("__tl_off")) for p in self.passes}).drop("__tl_off")
        return whole.unionByName(edge).drop("at", *self._each("take"), "edge")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, shard_1, shard_2 (one for each pass).

    ``size`` counts words (null and empty texts: 0, never taken); ``taken`` counts the words the mix takes, at most
    ``ceiling`` times the size; shard_p is the output shard that gets the copy of pass p, null if there is none. A null source is a source
    of its own, after the others. Rows that repeat a doc_id are separate documents; equal rows are interchangeable. An
    empty table gives an empty one. All draws are seeded hashes of the rows, so reruns agree. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    keyed = scratch.cut(with_keys(docs.select("doc_id", "source", "text")).drop("text"))
    plan = Mix(keyed, scratch, **options)
    taken = sum((F.col(f"__tl_take_{p}") for p in plan.passes), F.lit(0).cast("long"))
    shard = [F.when(F.col(f"__tl_take_{p}") > 0, F.col(f"__tl_shard_{p}")).alias(f"shard_{p}") for p in plan.passes]
    return plan.apply(keyed).select("doc_id", "source", F.col("__tl_size").alias("size"), F.col("__tl_source_size").alias("source_size"), F.col("__tl_target").alias("target"), taken.alias("taken"), *shard)


def mixed_rows(docs: DataFrame, shard_column: str | None = None, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken, and ``shard_column``, its shard, if one is named.

    Partitions are shards, each shard being a run of as many partitions as its words ask for: all its blocks are shuffled
    together there, across sources. The one document of a source at the edge of its target is cut to its first words; all
    others come whole. Null texts and texts without words are of no size, so the mix has none of them. Rows that repeat a
    doc_id are separate documents; an empty table gives an empty one; any other columns go along as they are.
    """
    if shard_column in docs.columns:
        raise ValueError(f"the documents have a column {shard_column} already")
    scratch = Scratch(docs.sparkSession)
    plan = Mix(scratch.cut(with_keys(docs.select("doc_id", "source", "text")).drop("text", "doc_id")), scratch, **options)
    got = plan.apply(with_keys(docs)).where(" or ".join(f"__tl_take_{p} > 0" for p in plan.passes))
    copies = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"__tl_take_{p}").alias("take"), F.col(f"__tl_shard_{p}").alias("shard")) for p in plan.passes]), lambda c: c["take"] > 0))
    got = got.withColumn("__tl_copy", copies)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("__tl_copy.take") == F.col("__tl_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("__tl_copy.take").cast("int")), " "))
    got = got.withColumns({"text": text, "__tl_shard": F.col("__tl_copy.shard"), "__tl_order": F.xxhash64("__tl_key", "__tl_copy.pass")})
    shards, words = options.get("shards", SHARDS), plan.sources.agg(F.sum("quota")).first()[0] or 0
    parts = max(1, -(-int(words) // (shards * PART_WORDS)))
    dealt = got.repartitionById(shards * parts, F.expr(f"cast(__tl_shard * {parts} + pmod(__tl_order, {parts}) as int)"))
    shard = [F.col("__tl_shard").cast("int").alias(shard_column)] if shard_column else []
    return dealt.sortWithinPartitions("__tl_order").select(*docs.columns, *shard)
