"""Conversation prefix trie with a pointer-jumping rollup.

A node of the trie is a sequence of turns that some conversation starts with, named by a digest. A prefix's digest comes from
sums: each turn gives four 32-bit numbers from the MD5 of its place and its contents, and a prefix has the sums of those of its
turns. Sums can be made block by block, so neither the places of the turns nor the digests of a conversation that holds a third
of all rows need one task. Texts leave the plan at its first step; only their digests and lengths are shuffled.

Every node but the root has an edge to its parent. Totals of subtrees come from doubling: after round k a node has the totals
of its descendants less than 2**k below it and a pointer 2**k above it; it gives its totals to the node it points at, and takes
that node's pointer for its own. Nodes whose pointer leaves the trie drop out of later rounds, so the work falls from round to
round and the number of rounds is the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns of a conversation whose sums one window makes.
BLOCK = 1 << 16
#: Characters by which texts of turns with equal number and role are ordered; what is equal so far is ordered by digest.
HEAD = 64
#: Ids that are joined to one piece before they are hashed.
TOGETHER = 10_000
SUMS = ("s0", "s1", "s2", "s3")
_ROOT = hashlib.md5(b"root").digest()


def ordered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows of conv_id, place, last, item, bytes; conversations of conv_id, n): turns in order, numbered from 1, without texts.

    Turns are range-partitioned by conversation and order; a place is the place within the partition and the rows of the
    conversation in those before it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    item = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    t = t.select("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), item.alias("item"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("nth"))
    order = ["turn", "role", "head", "item", "nth"]
    dealt = scratch.cut(t.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = scratch.cut(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("rows")))
    w = Window.partitionBy("conv_id")
    before = F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    sizes = sizes.select("conv_id", "part", before.alias("before"), F.sum("rows").over(w).alias("n"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) + F.col("before")
    rows = dealt.join(sizes, ["conv_id", "part"]).select("conv_id", place.alias("place"), "n", "item", "bytes")
    rows = scratch.cut(rows.select("conv_id", "place", (F.col("place") == F.col("n")).alias("last"), "item", "bytes"))
    return rows, rows.groupBy("conv_id").agg(F.count("*").alias("n"))


def rebuilt(rows: DataFrame, convs: DataFrame, scratch: Scratch, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations with common beginnings, as ``ordered`` gives them.

    The first h turns of conversation c - c % group (all, if it has fewer; none, if there is no such) take the place of c's
    own first h; h is crc32 of c's decimal digits modulo ``most``.
    """
    c = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0)))
    c = c.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("lead", lead)
    c = scratch.cut(c.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    firsts = rows.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "item", "bytes")
    begun = c.where("lead > 0").join(firsts, "base").where("place <= lead").select("conv_id", "place", (F.col("place") == F.col("n")).alias("last"), "item", "bytes")
    own = rows.join(c, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "last", "item", "bytes")
    return begun.unionByName(own), c.select("conv_id", "n")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.when(depth == 0, F.lit(_ROOT)).otherwise(F.unhex(F.md5(F.concat_ws(":", *[x.cast("string") for x in (depth, *sums)]))))


def _entries(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation and node on its way: key, parent, conv_id, depth, bytes, last."""
    digest = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.hex("item")))
    r = rows.withColumn("digest", digest).withColumns({s: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i, s in enumerate(SUMS)})
    r = scratch.cut(r.withColumn("block", F.expr(f"(place - 1) div {BLOCK}")).drop("item", "digest"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    blocks = scratch.cut(r.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in SUMS]))
    to_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = blocks.select("conv_id", "block", *[(F.sum(s).over(to_block) - F.col(s)).alias(f"{s}_before") for s in SUMS]).where("block > 0")
    r = r.withColumns({f"{s}_in": F.sum(s).over(so_far) for s in SUMS}).join(before, ["conv_id", "block"], "left")
    whole = [F.col(f"{s}_in") + F.coalesce(f"{s}_before", F.lit(0)) for s in SUMS]
    up = [x - F.col(s) for x, s in zip(whole, SUMS, strict=True)]
    return scratch.cut(r.select(_key(F.col("place"), whole).alias("key"), _key(F.col("place") - 1, up).alias("parent"), "conv_id", F.col("place").alias("depth"), "bytes", "last"))


def _runs(batches) -> Iterator[tuple[bytes, int, list[int]]]:
    """Sorted rows (key, part, conv_id) in runs of one key, of TOGETHER ids at most."""
    key, part, held = None, 0, []
    for batch in batches:
        for k, p, c in zip(*(batch.column(n).to_pylist() for n in ("key", "part", "conv_id")), strict=True):
            if k != key or len(held) == TOGETHER:
                if held:
                    yield key, part, held
                held = []
            key, part = k, p
            held.append(c)
    if held:
        yield key, part, held


def _joined(batches):
    names = ("key", "part", "seq", "ids")
    rows = []
    for seq, (key, part, ids) in enumerate(_runs(batches)):
        rows.append((key, part, seq, ",".join(map(str, ids))))
        if len(rows) == 1000 or len(ids) == TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=names)


def _hashed(batches):
    """Pieces of ids, sorted by key, part and seq, to one digest a key; a key's ids pass by piece by piece."""
    key, sha, out = None, None, ([], [])

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["key", "sha"])
        out[0].clear()
        out[1].clear()
        return made

    for b in batches:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out[0].append(key)
                    out[1].append(sha.hexdigest())
                    if len(out[0]) == 10_000:
                        yield batch()
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if key is not None:
        out[0].append(key)
        out[1].append(sha.hexdigest())
    yield batch()


def _ends(ends: DataFrame) -> DataFrame:
    """(key, conv_id) to (key, sha): SHA-256 of each key's ids in ascending order, joined by commas."""
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())
    pieces = dealt.mapInArrow(_joined, "key binary, part int, seq long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(_hashed, "key binary, sha string")


def rollup(rows: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie's nodes with the totals of their subtrees, from rows and conversations as ``ordered`` or ``rebuilt`` give them."""
    entries = _entries(rows, scratch)
    base = entries.groupBy("key").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(_ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    base = scratch.cut(base.unionByName(root))
    children = base.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = base.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.cut(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))

    depth = nodes.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    below = nodes.select("key", "leaves", "saved")
    moving = nodes.where("parent is not null").select("key", F.col("parent").alias("up"), "leaves", "saved")
    for k in range(depth.bit_length()):
        given = scratch.cut(moving.groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        below = below.unionByName(given)
        if 2 << k > depth:
            break
        further = moving.select(F.col("key").alias("up"), F.col("up").alias("further"))
        more = given.select("key", F.col("leaves").alias("l"), F.col("saved").alias("s"))
        moved = moving.join(further, "up").join(more, "key", "left")
        moving = scratch.cut(moved.select("key", F.col("further").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    totals = below.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = entries.where("last").select("key", "conv_id").unionByName(convs.where("n = 0").select(F.lit(_ROOT).alias("key"), "conv_id"))
    out = nodes.drop("leaves", "saved", "bytes").join(totals, "key").join(_ends(ends), "key", "left")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = scratch.cut(out).join(parents, "parent", "left")
    sha = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def prefix_trie(turns: DataFrame, shared: bool = False) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text): a row for each node.

    ``shared``: of conversations whose beginnings are those of others, see ``rebuilt``. Columns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (bytes of texts that a cache of prefixes saves in the subtree) and
    ends_sha256 (of the members that end there). Turns stand in order of ``turn`` (null first), ties by role, the first 64 characters of
    the text and a digest; repeated rows are turns of their own. Null roles and texts are empty ones; rows without a conv_id belong to no
    conversation and are left out. Empty and very long texts are texts like others. An empty table gives an empty one;
    other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    rows, convs = ordered(turns, scratch)
    return rollup(*(rebuilt(rows, convs, scratch) if shared else (rows, convs)), scratch)
