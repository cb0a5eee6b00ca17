"""Near copies by the Jaccard similarity of five-word shingles: byte-position index, count filtering, exact verification.

A text's fingerprint has ``POSITIONS`` positional bytes, each one byte of a minimum hash over its set of shingles, so two texts
share a position with a probability of their similarity or a little more. The index stores intersections of four postings:
``POSITIONS`` / 4 blocks. A pair of similarity 0.8 meets in none of the 32 blocks with a probability of 5e-8, and shares
fewer than ``MIN_SHARED`` of the bytes (expected: 102) with one of 1e-10. Pairs that meet are tallied; the pairs that pass only
say which texts are gathered to be compared. What counts as near copies is decided by the whole shingle sets.

No list is cut: the members of a posting list over ``PAIRS_TOGETHER`` are gathered as one, without the tally. Groups over
``GROUP_HASHES`` are compared first with one member, then whoever isn't near it with all, in chunks spread over tasks.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, sieve, small_batches, star_components
from .simhash import SEED, keep_least

WORDS = 5
SIMILARITY = (4, 5)
POSITIONS, BLOCK = 128, 4
MIN_SHARED = 72
#: Posting lists up to this length give all their pairs.
PAIRS_TOGETHER = 64
#: Hashes that are compared within a task; 8 MB.
GROUP_HASHES = 1 << 20
_FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, POSITIONS, np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The set of shingle hashes, sorted; a text under five words is one shingle, one without words has none."""
    words = text.lower().split()
    n = len(words) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def signature(hashes: np.ndarray) -> bytes:
    """The positional bytes of a set."""
    if not len(hashes):
        return bytes(POSITIONS)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS).min(axis=0), out=least)
    return least.astype(np.uint8).tobytes()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]


def _signed(batches):
    for batch in batches:
        same, size, sig = [], [], []
        for text in _texts(batch):
            h = shingles(text)
            same.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
            size.append(len(h))
            sig.append(signature(h))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "key", "same", "size", "sig"])


def _pairs(batches):
    """Rows sorted by list: all pairs of a list, or each member with the first (`sure`) if the list is long."""

    def links(lists, nodes, edges):
        starts, n = edges[:-1], np.diff(edges)
        two = starts[n == 2]
        u, v, sure = [nodes[two]], [nodes[two + 1]], [np.zeros(len(two), bool)]
        for a, k in zip(starts[n > 2].tolist(), n[n > 2].tolist(), strict=True):
            if k > PAIRS_TOGETHER:
                i, j = np.zeros(k - 1, np.int64), np.arange(1, k)
            else:
                i, j = np.triu_indices(k, 1)
            u.append(nodes[a + i])
            v.append(nodes[a + j])
            sure.append(np.full(len(i), k > PAIRS_TOGETHER))
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.concatenate(sure))], names=["u", "v", "sure"])

    lists, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        lists = np.concatenate([lists, batch.column(0).to_numpy()])
        nodes = np.concatenate([nodes, batch.column(1).to_numpy()])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1]) if len(lists) else np.zeros(1, np.int64)
        yield links(lists, nodes, edges)
        lists, nodes = lists[edges[-1] :], nodes[edges[-1] :]
    yield links(lists, nodes, np.array([0, len(lists)]))


def _tallied(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("a", "b"))
        ok = pa.array((a == b).sum(axis=1) >= MIN_SHARED)
        yield batch.select(["u", "v"]).filter(ok)


def _sets(batches):
    for batch in batches:
        sets = [shingles(t).tobytes() for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "key", "hashes"])


def near(common, a, b):
    """Whether sets of sizes a and b with so many common elements reach the similarity."""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def forest(nodes: list[int], sets: list[np.ndarray], asks: list[bool]) -> list[tuple[int, int]]:
    """Links that connect each asking set with all sets near it; sets that are connected already aren't compared further."""
    parent, left = list(range(len(nodes))), len(nodes) - 1

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    at, out = ends - size, []
    for i in range(len(nodes)):
        if not left:
            break
        if not asks[i] or not size[i]:
            continue
        mark = np.zeros(len(code), bool)
        mark[code[at[i] : ends[i]]] = True
        total = np.concatenate([[0], np.cumsum(mark[code])])
        for j in np.flatnonzero(near(total[ends] - total[at], size[i], size)).tolist():
            p, q = find(i), find(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left -= 1
                if nodes[i] != nodes[j]:
                    out.append((nodes[i], nodes[j]))
    return out


def _compared(batches):
    """Rows sorted by (root, a, b): the links within each group."""
    held: list[tuple] = []

    def flush():
        got = forest([r[0] for r in held], [np.frombuffer(r[2], np.uint64) for r in held], [r[1] for r in held])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["u", "v"])

    last = None
    for batch in batches:
        for root, a, b, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "a", "b", "node", "asks", "hashes")), strict=True):
            if held and last != (root, a, b):
                yield flush()
            last = (root, a, b)
            held.append(tuple(row))
    if held:
        yield flush()


def _near_first(batches):
    for batch in batches:
        first, own = (batch.column(c).to_pylist() for c in ("first", "hashes"))
        ok = []
        for x, y in zip(first, own, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            ok.append(bool(near(len(np.intersect1d(x, y, True)), len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(ok)], names=["root", "node", "joined"])


def candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) among ``nodes`` (node, sig): pairs that meet in a block and share enough bytes."""
    block = F.explode(F.sequence(F.lit(0), F.lit(POSITIONS // BLOCK - 1)))
    index = nodes.select("node", "sig", block.alias("block")).select(F.xxhash64("block", F.expr(f"substring(sig, block * {BLOCK} + 1, {BLOCK})")).alias("list"), "node")
    met = scratch.cut(index.repartition("list").sortWithinPartitions("list", "node").select("list", "node").mapInArrow(_pairs, "u long, v long, sure boolean").groupBy("u", "v").agg(F.max("sure").alias("sure")))
    a, b = nodes.select(F.col("node").alias("u"), F.col("sig").alias("a")), nodes.select(F.col("node").alias("v"), F.col("sig").alias("b"))
    return met.where("sure").select("u", "v").unionByName(met.where("not sure").select("u", "v").join(a, "u").join(b, "v").mapInArrow(_tallied, "u long, v long"))


def links(docs: DataFrame, members: DataFrame, scratch: Scratch, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """Links (u, v) that connect all near copies among ``members`` (doc_id, key, node, root, size) of one root."""
    key = F.xxhash64("doc_id", "text")
    read = in_sieve(docs.select("doc_id", key.alias("key"), F.col("text").cast("string").alias("text")), "key", sieve(members, "key")).where("__tl_in").drop("__tl_in")
    found = read.mapInArrow(_sets, T.StructType([docs.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("hashes", T.BinaryType())]))
    m = members.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "node", "root")
    # rows that are equal in doc_id and text give one set several times, which changes nothing
    sets = scratch.cut(found.join(m, found["doc_id"].eqNullSafe(m["d"]) & (found["key"] == m["k"])).select("root", "node", "hashes"))
    n_chunks = F.ceil(F.sum("size") / group_hashes).cast("long")
    groups = scratch.cut(members.groupBy("root").agg(n_chunks.alias("n"), F.min("node").alias("first")))
    order = ["root", "a", "b"]
    compared = lambda rows: rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared, "u long, v long")
    at_once = lambda rows: rows.select("root", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "node", F.lit(True).alias("asks"), "hashes")
    if groups.where("n > 1").isEmpty():
        return compared(at_once(sets))
    rows = sets.join(groups.select("root", "n"), "root")
    large = rows.where("n > 1")
    # of the large groups only: a row for each
    first = groups.where("n > 1").select("root", F.col("first").alias("node")).join(sets.withColumnRenamed("hashes", "first"), ["root", "node"]).dropDuplicates(["root"]).drop("node")
    joined = scratch.cut(large.join(first, "root").select("root", "node", "hashes", "first").mapInArrow(_near_first, "root long, node long, joined boolean").distinct())
    rest = joined.where("not joined")
    n_rest = rest.groupBy("root").agg(F.count("*").alias("r"))
    salt = lambda s, n: F.pmod(F.xxhash64(F.lit(s), "node"), F.col(n))
    both = large.join(n_rest, "root").withColumn("parts", F.least("n", "r"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = both.join(rest.select("root", "node"), ["root", "node"], "left_semi").select("root", salt(1, "parts").alias("a"), each("n").alias("b"), "node", F.lit(True).alias("asks"), "hashes")
    asked = both.select("root", each("parts").alias("a"), salt(2, "n").alias("b"), "node", F.lit(False).alias("asks"), "hashes")
    pairs = compared(at_once(rows.where("n <= 1")).unionByName(asking).unionByName(asked))
    hub = joined.where("joined").join(groups.select("root", "first"), "root").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return pairs.unionByName(hub)


def grouped(docs: DataFrame, scratch: Scratch, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """(doc_id, key, root) for every row of ``docs``; rows of one root are connected by near copies."""
    read = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t()) for n, t in (("key", T.LongType), ("same", T.BinaryType), ("size", T.LongType), ("sig", T.BinaryType))]])
    with small_batches(docs.sparkSession):
        signed = scratch.cut(read.mapInArrow(_signed, schema))
    nodes = scratch.cut(signed.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("row"), F.min("size").alias("size"), F.min("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))
    maybe = star_components(candidates(nodes.where("size > 0").select("node", "sig"), scratch), scratch)
    both = scratch.cut(maybe.select(F.col("u").alias("node"), "root").unionByName(maybe.select(F.col("root").alias("node"), "root").distinct()))
    members = scratch.cut(nodes.join(both, "node").select("row.doc_id", "row.key", "node", "root", "size"))
    with small_batches(docs.sparkSession):  # the sets are made and compared
        roots = star_components(links(docs, members, scratch, group_hashes), scratch).withColumnRenamed("u", "node")
    label = nodes.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "key", "same").join(label, "same").select("doc_id", "key", "root")


def keep_one(docs: DataFrame, group_hashes: int = GROUP_HASHES) -> DataFrame:
    """``docs`` with one row for each group of near copies, that of the smallest doc_id (null last); all columns stay.

    Texts are near copies if the Jaccard similarity of their sets of five-word shingles (A-Z lower-cased) is 0.8 or more, or if
    they have the same words; groups are the connected components. Texts without words are copies of each other.
    """
    scratch = Scratch(docs.sparkSession)
    return keep_least(docs, scratch.cut(grouped(docs, scratch, group_hashes)), scratch)
