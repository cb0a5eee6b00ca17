"""Substring deduplication: seed with winnowed anchors, extend to windows, keep maximal repeats.

A passage counts as repeated from ``WINDOW`` words on. Every window of that many words selects one of its k-grams, the one
of the least hash, as its anchor: equal windows select equal anchors at equal places. So only windows around an anchor that
occurs twice can repeat. The seeds are counted over the corpus (an eighth of the words), and documents that share one are
extended both ways from it, word by word, as far as a window reaches: each of their windows around a shared anchor is compared
through 128 bits of its whole word sequence (two hashes with bases of their own). Overlapping repeated windows merge into the
maximal repeats, which are removed.

Equal texts are recognised first and count as repeats of each other from ``WINDOW`` words on; one of them stands for all
when windows are compared. Windows that repeat within a task's batch are settled there and sent on once, so a passage that
a third of all documents share reaches the shuffle once a batch.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

WINDOW = 35
#: Words of an anchor.
GRAM = 12
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_U = np.uint64


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as they have been needed."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def to(cls, n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        up, down = cls.known.get(base, (np.zeros(0, _U), np.zeros(0, _U)))
        if len(up) < n:
            m = max(n, 2 * len(up), 4096)
            up, down = cls.known[base] = np.cumprod(np.full(m, base, _U)), np.cumprod(np.full(m, pow(base, -1, 1 << 64), _U))
        return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def windows(words: list[bytes], window: int = WINDOW, gram: int = GRAM, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its hash of 128 bits (two columns; none unless ``hashed``), the place of its anchor; and the hashes of all k-grams."""
    n = len(words)
    if n < window:
        return np.zeros((0, 2), _U), np.zeros(0, np.int64), np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(7)), _U, n)
    up, down = _Powers.to(n)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(h * down)])
    grams = _mix((total[gram:] - total[:-gram]) * up[gram - 1 :])
    whole = np.zeros((0, 2), _U)
    if hashed:
        one = _mix((total[window:] - total[:-window]) * up[window - 1 :] + _U(window))
        up, down = _Powers.to(n, _OTHER)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(8)), _U, n) * down)])
        whole = np.stack([one, _mix((total[window:] - total[:-window]) * up[window - 1 :])], axis=1)
    width = window - gram + 1
    m, step = n - window + 1, 50_000  # the view is read in blocks
    anchor = np.concatenate([np.lib.stride_tricks.sliding_window_view(grams[at : min(m, at + step) + width - 1], width).argmin(axis=1) for at in range(0, m, step)])
    return whole, anchor + np.arange(m), grams


def _anchors(batches):
    for batch in batches:
        n_words, sha, offsets, values = [], [], [0], []
        for x in batch.column(3).cast(pa.binary()):
            words = (x.as_py() or b"").split()
            n_words.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).digest())
            _, anchor, grams = windows(words, hashed=False)
            values.append(grams[np.unique(anchor)].view(np.int64))
            offsets.append(offsets[-1] + len(values[-1]))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(sha, pa.binary()), lists], names=["doc_id", "h1", "h2", "n_words", "sha", "anchors"])


def _candidates(batches):
    """Of each text (row, h1, h2, text, shared anchors): the windows around a shared anchor.

    Windows that repeat within the batch are listed in ``here``; the others in ``keys`` and ``starts``. A last row without
    text lists a key for each window that repeats here, for other batches to meet.
    """
    names = ["row", "h1", "h2", "text", "here", "keys", "more", "starts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        keys, starts = [], []
        for x, shared in zip(batch.column(3).cast(pa.binary()), batch.column(4), strict=True):
            whole, anchor, grams = windows((x.as_py() or b"").split())
            at = np.nonzero(np.isin(grams[anchor].view(np.int64), np.array(shared.as_py(), np.int64)))[0]
            keys.append(whole[at].view(np.int64))
            starts.append(at.astype(np.int32))
        every = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
        order = np.lexsort(every.T)
        new = np.concatenate([[True], (every[order][1:] != every[order][:-1]).any(axis=1)]) if len(every) else np.zeros(0, bool)
        times = np.diff(np.flatnonzero(np.concatenate([new, [True]])))
        met, twice = every[order][new][times > 1], np.zeros(len(every), bool)
        twice[order] = np.repeat(times > 1, times)
        rows, at = ([], [], [], []), 0
        for k, s in zip(keys, starts, strict=True):
            t = twice[at : at + len(k)]
            at += len(k)
            for out, v in zip(rows, (s[t], k[~t, 0], k[~t, 1], s[~t]), strict=True):
                out.append(v)
        cols = [*batch.columns[:3], batch.column(3).cast(pa.binary()), *[pa.array(v, t) for v, t in zip(rows, kinds[4:], strict=True)]]
        yield pa.RecordBatch.from_arrays(cols, names=names)
        if len(met):
            last = [[None], [None], [None], [None], [[]], [met[:, 0]], [met[:, 1]], [np.full(len(met), -1, np.int32)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(last, kinds, strict=True)], names=names)


def _repeated(batches):
    """Rows (row, start) of keys that stand more than once in a partition sorted by key."""
    held = None  # the last row so far, and whether its key has been met before
    for batch in batches:
        if not batch.num_rows:
            continue
        key, more, row, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        hit = np.zeros(len(key), bool)
        if held:
            key, more, row, start = (np.concatenate([[h], x]) for h, x in zip(held, (key, more, row, start), strict=False))
            hit = np.concatenate([[held[4]], hit])
        same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
        hit[1:] |= same
        hit[:-1] |= same
        held = (key[-1], more[-1], row[-1], start[-1], hit[-1])
        on = hit[:-1] & (row[:-1] >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(row[:-1][on], pa.int64()), pa.array(start[:-1][on], pa.int32())], names=["row", "start"])
    if held and held[4] and held[2] >= 0:
        yield pa.RecordBatch.from_arrays([pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int32())], names=["row", "start"])


_SPANS = "array<struct<start:int,end:int>>"


def _cut(batches):
    """(h1, h2, text, here, starts) to the spans removed and the digest of what is kept."""
    for batch in batches:
        spans, removed, sha = [], [], []
        for x, here, starts in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            words = (x.as_py() or b"").split()
            at = np.unique(np.array((here.as_py() or []) + (starts.as_py() or []), np.int64))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).digest())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), pa.array(spans, kind)], names=["h1", "h2", "n_gone", "sha_left", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, removed (word ranges, end exclusive).

    Null and empty texts have no words. Texts shorter than the window keep all their words, however often they occur; of
    equal longer texts none keeps any. Rows that repeat a doc_id count as separate documents. An empty table gives an
    empty one; columns besides doc_id and text are ignored. Equality of windows is that of 128 bits of their words.
    """
    scratch = Scratch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    longs = ["h1", "h2", "n_words"]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("sha", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])
    seeds = scratch.cut(keyed.mapInArrow(_anchors, schema))
    texts = scratch.cut(seeds.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")))
    ones = texts.select(F.col("one").alias("doc_id_"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    one = seeds.join(ones, F.expr("h1 = g1 and h2 = g2 and doc_id <=> doc_id_")).select("h1", "h2", "doc_id", "anchors")
    # written, so that the join's sides are plain shuffles and a frequent anchor's rows can be split
    shared = scratch.cut(one.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    mine = one.select("h1", "h2", "doc_id", F.explode(F.array_distinct("anchors")).alias("anchor"))
    found = mine.join(shared, "anchor").groupBy("h1", "h2", "doc_id").agg(F.collect_set("anchor").alias("shared"))
    found = scratch.cut(found.withColumn("row", F.monotonically_increasing_id()))
    near = found.withColumnsRenamed({"h1": "g1", "h2": "g2", "doc_id": "doc_id_"})
    pair = keyed.join(near, F.expr("h1 = g1 and h2 = g2 and doc_id <=> doc_id_")).select("row", "h1", "h2", "text", "shared")
    cand = scratch.cut(pair.mapInArrow(_candidates, "row long, h1 long, h2 long, text binary, here array<int>, keys array<long>, more array<long>, starts array<int>"))
    open_ = cand.select("row", F.explode(F.arrays_zip("keys", "more", "starts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.more").alias("more"), F.coalesce("row", F.lit(-1)).alias("row"), F.col("x.starts").alias("start"))
    met = open_.repartition("key", "more").sortWithinPartitions("key", "more").mapInArrow(_repeated, "row long, start int").groupBy("row").agg(F.collect_list("start").alias("more"))
    done = cand.where("row is not null").select("row", "h1", "h2", "text", "here").join(met, "row", "left").where("size(here) > 0 or more is not null")
    cut = done.select("h1", "h2", "text", "here", "more").mapInArrow(_cut, f"h1 long, h2 long, n_gone long, sha_left binary, spans {_SPANS}").dropDuplicates(["h1", "h2"])
    # written, so that the copies of one text can be split in the join
    fate = scratch.cut(texts.drop("one").join(cut, ["h1", "h2"], "left"))
    out = seeds.drop("anchors").join(fate, ["h1", "h2"])
    all_gone = F.expr(f"copies > 1 and n_words >= {WINDOW}")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_gone", F.lit(0))).alias("n_removed"),
        F.when(all_gone, empty).otherwise(F.lower(F.hex(F.coalesce("sha_left", "sha")))).alias("kept_sha256"),
        F.when(all_gone, whole).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})"))).alias("removed"),
    )
