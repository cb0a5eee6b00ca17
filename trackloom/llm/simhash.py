"""SimHash near-duplicates: byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most three bits differ in at most three
bytes, so they share at least five positional bytes: that is the count threshold. Walking the posting list of every single
(position, byte) would cost the square of a list of one 256th of all rows, so the index stores intersections of four
postings: the 14 four-position blocks of the Steiner system S(3, 4, 8). Whatever three positions differ, exactly one block
avoids them, so every pair that reaches the count meets in a block, and a list holds only what shares 32 bits already.
Within a list the shared positional bytes of each pair are tallied, pairs below five are dropped, and the rest is verified
by its differing bits.

Lists of up to ``list_limit`` fingerprints are compared in one task, in blocks, and yield a spanning forest, never pairs.
Longer lists are not cut but split further by the index itself: their members share four bytes and must share a fifth, so
each of the other four positions splits the list by its byte. A list that is still too long shares five bytes; its members
differ in at most three of the six half bytes left, so each triple of half bytes splits it again, into lists of at most 4,096
distinct fingerprints. Each step finds every pair that the list holds.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_sieve, sieve, star_components

SEED = 42
MAX_BITS = 3
#: Positional bytes that any pair within MAX_BITS shares.
MIN_SHARED = 8 - MAX_BITS
#: The 14 blocks: four positions whose numbers have exclusive-or zero.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Lists up to this length are compared within a task; 128 KB of fingerprints.
LIST_LIMIT = 16384


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 bytes: A-Z lower-cased, 3-word shingles, repeats counted."""
    words = text.lower().split()  # bytes: only A-Z change, and only \x20 and \x09-\x0D separate
    if not words:
        return 0
    xx = xxhash.xxh64_intdigest
    if len(words) < 3:
        return xx(b" ".join(words), SEED)
    n = len(words) - 2
    h = np.fromiter(map(xx, map(b" ".join, zip(words, words[1:], words[2:], strict=False)), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 64):
        bits = np.unpackbits(h[at : at + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        fp = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: list[Column | str] | None = None) -> DataFrame:
    """``keep`` (doc_id) and fp for every row; null text has fingerprint zero. Other columns are not looked at."""
    rows = docs.select(*(keep or ["doc_id"]), F.col("text").cast("string").alias("__tl_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


def _differ_bytes(x: np.ndarray) -> np.ndarray:
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count((((x & low) + low) | x) & ~low)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in one posting list, as indices."""
    n = len(fps)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a in range(0, n, 128):
        x = fps[a : a + 128, None] ^ fps[None, a:]
        i, j = np.nonzero(_differ_bytes(x) <= 8 - MIN_SHARED)
        i, j = i[j > i], j[j > i]
        near = np.bitwise_count(x[i, j]) <= MAX_BITS
        for p, q in zip((i[near] + a).tolist(), (j[near] + a).tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((p, q))
    return out


def _list_links(batches):
    for batch in batches:
        lists, u, v = batch.column(0), [], []
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
            fps = np.sort(values[a:b])
            for i, j in forest(fps.view(np.uint64)):
                u.append(fps[i])
                v.append(fps[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _split(mask: int) -> list[int]:
    """What the members of a long list, which agree in the bits of ``mask``, are split by: the bits they agree in then."""
    rest = [p for p in range(8) if not mask >> 8 * p & 0xFF]
    if len(rest) == 4:
        return [mask | 0xFF << 8 * p for p in rest]
    halves = [8 * p + low for p in rest for low in (0, 4)]
    return [mask | sum(0xF << h for h in three) for three in combinations(halves, 3)]


def links(fps: DataFrame, scratch: Scratch, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps(fp)`` that connect all pairs within MAX_BITS."""
    agree = lambda masks: F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    index = fps.select("fp", agree([sum(0xFF << 8 * p for p in b) for b in BLOCKS]).alias("mask"))
    masks, found = [sum(0xFF << 8 * p for p in b) for b in BLOCKS], None
    for last in (False, False, True):
        index = index.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = index.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = index.join(sizes, ["mask", "key"])
        short = shared if last else shared.where(F.col("n") <= list_limit)
        own = short.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_list_links, "u long, v long")
        found = own if found is None else found.unionByName(own)
        if last:
            break
        long = scratch.cut(shared.where(F.col("n") > list_limit).select("fp", "mask"))
        if long.isEmpty():
            break
        into = {m: _split(m) for m in masks}
        masks = sorted({m for own in into.values() for m in own})
        split = F.create_map(*[x for m, own in into.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in own]))])
        index = long.select("fp", F.explode(F.element_at(split, F.col("mask"))).alias("mask")).distinct()
    return found


def _grouped(of_doc: DataFrame, scratch: Scratch, list_limit: int) -> DataFrame:
    """``of_doc`` (doc_id, fp, ...) with root, the least fingerprint of its component, and component_id."""
    of_fp = scratch.cut(of_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = star_components(links(of_fp.select("fp"), scratch, list_limit), scratch)
    label = scratch.cut(of_fp.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written, here and below: the sides of these joins are plain shuffles then, and a large component's rows can be split
    ids = scratch.cut(label.groupBy("root").agg(F.min("least").alias("component_id")))
    return of_doc.join(scratch.cut(label.join(ids, "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id.

    Rows with equal fingerprints, and fingerprints within three bits, are linked; component_id is the smallest doc_id
    that can be reached. Null and empty texts have fingerprint zero and are linked like any other; a null doc_id is kept
    and never chosen unless its whole component has none; rows that repeat a doc_id stay separate rows; an empty table
    gives an empty one; columns besides doc_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    return _grouped(scratch.cut(fingerprints(docs)), scratch, list_limit).select("doc_id", "fp", "component_id")


def hex16(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_least(docs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row for each root of ``groups`` (doc_id, key: xxhash64 of doc_id and text, root), that of the smallest doc_id.

    Rows are told apart by doc_id and key; of rows equal in both, one stays. A sieve finds the rows that may go; only
    those are joined with the ones that do.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    best = scratch.cut(groups.groupBy("root").agg(F.min(rank).alias("best")))
    gone = groups.join(best, "root").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))).select("doc_id", "key").distinct().withColumn("twice", F.lit(False))
    twice = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").join(best.select(F.col("best.doc_id").alias("d"), F.col("best.key").alias("k")), F.expr("doc_id <=> d and key = k")).select("doc_id", "key", F.lit(True).alias("twice"))
    fate = scratch.cut(gone.unionByName(twice)).select(F.col("doc_id").alias("__tl_id"), F.col("key").alias("__tl_k"), F.col("twice").alias("__tl_twice"))
    keyed = in_sieve(docs.withColumn("__tl_key", F.xxhash64("doc_id", "text")), "__tl_key", scratch.cut(sieve(fate, "__tl_k")))
    safe, asked = keyed.where("not __tl_in"), keyed.where("__tl_in")
    met = asked["doc_id"].eqNullSafe(fate["__tl_id"]) & (asked["__tl_key"] == fate["__tl_k"])
    once = asked.join(fate, met, "left_anti")
    again = asked.join(fate.where("__tl_twice"), met, "left_semi").dropDuplicates(["doc_id", "__tl_key"])
    return safe.unionByName(once).unionByName(again).select(*docs.columns)


def keep_one(docs: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``docs`` with one row for each group of op1's near-duplicates, that of the smallest doc_id (null last); all columns stay."""
    scratch = Scratch(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    groups = scratch.cut(_grouped(scratch.cut(fingerprints(docs, ["doc_id", key.alias("key")])), scratch, list_limit).select("doc_id", "key", "root"))
    return keep_least(docs, groups, scratch)
