"""Source divergence audit by sketch-prefiltered counting.

First pass: each task adds the documents that hold a term to a count-min sketch by (language, term). Cells stop at the least
number of documents asked for, so a task's sketch has a fixed size however many terms it saw; the sketches are merged by
blocks, in two levels. A cell never counts less than the documents of any of its terms, so a term with one cell below the
limit can't reach it and is discarded in the second pass before anything of it is shuffled. Survivors are counted exactly, by
language, source and term, and only exact counts decide what is kept: a sketch that is too small for a corpus lets more terms
through, and the result stays the same.

Divergences of pairs of sources come from joins over the terms that both have. What a pair's other terms add follows from how
many terms a source has of each count, as an absent term's share depends on the source alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_DOCS, TOP = 10, 10
#: Rows of the sketch, and the least and most cells of a row, as powers of two: one for each 1,024 bytes of text between them.
ROWS, CELLS = 4, (16, 24)
BLOCK = 1 << 16
#: Sketches of a block that meet first.
SALTS = 32
#: Terms, and pairs of a document and a term, that a task holds before it passes their counts on; rows that it hands over at once.
HELD, PAIRS, HANDED = 400_000, 2_500_000, 20_000
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20
#: p is a share in units of this.
UNIT = 1_000_000_000

#: Only ASCII letters and what isn't ASCII belong to terms; A-Z become a-z.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b > 127 else 32 for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of some PIECE bytes."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _places(lang: str, found: list[bytes], bits: int) -> np.ndarray:
    """The cells of terms of a language, a line for each row of the sketch."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found, repeat(xxhash.xxh32_intdigest(lang.encode()))), np.uint64, len(found))
    return ((h * _ODD[:, None]) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(cells: np.ndarray) -> bytes:
    """A block's cells: those that aren't zero with their places, or all of them, whichever is shorter."""
    some = np.flatnonzero(cells)
    if len(some) * (2 + cells.itemsize) < cells.nbytes:
        return b"s" + some.astype(np.uint16).tobytes() + cells[some].tobytes()
    return b"d" + cells.tobytes()


def _add(total: np.ndarray, raw: bytes, most: int) -> None:
    own = total.dtype
    if raw[:1] == b"d":
        at, more = slice(None), np.frombuffer(raw, own, offset=1)
    else:
        n = (len(raw) - 1) // (2 + own.itemsize)
        at, more = np.frombuffer(raw, np.uint16, n, 1), np.frombuffer(raw, own, n, 1 + 2 * n)
    total[at] = np.minimum(total[at].astype(np.int64) + more, most)


def _tallies(batches) -> Iterator[tuple[list[bytes], list[tuple[str, str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (lang, source, text) to (terms, groups, group, term, occurrences, documents), the last four a row for each group and term.

    Terms get numbers, rising but with gaps, so that counting is sorting numbers. What a task holds is bounded by HELD and PAIRS;
    it stops at the end of a document.
    """
    label: dict[bytes, int] = {}
    groups: dict[tuple[str, str], int] = {}
    found, times, owner, size = [], [], [], 0

    def tally():
        code = np.repeat(np.array(owner, np.int64) << 32, [len(x) for x in found]) | np.concatenate(found)
        order = np.argsort(code)
        code = code[order]
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), start)
        place = np.zeros(size, np.int64)
        place[np.fromiter(label.values(), np.int64, len(label))] = np.arange(len(label))
        out = list(label), list(groups), code[start] >> 32, place[code[start] & 0xFFFFFFFF], n, np.diff(start, append=len(code))
        for x in (label, groups, found, times, owner):
            x.clear()
        return out

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = Counter()
            for piece in terms(text.as_py()):
                own.update(piece)
            if not own:
                continue
            found.append(np.fromiter(map(label.setdefault, own, count(size)), np.uint32, len(own)))
            times.append(np.fromiter(own.values(), np.int32, len(own)))
            owner.append(groups.setdefault((lang, source), len(groups)))
            size += len(own)
            if size > PAIRS or len(label) > HELD:
                yield tally()
                size = 0
    if found:
        yield tally()


def _sketches(bits: int, most: int):
    """Texts (lang, text) to the blocks of the task's sketch."""

    def run(batches):
        cells = np.zeros((ROWS, 1 << bits), np.min_scalar_type(most))
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> None:
            for lang, seen in held.items():
                n = np.fromiter(seen.values(), np.int64, len(seen))
                for row, at in zip(cells, _places(lang, list(seen), bits), strict=True):
                    once, back = np.unique(at, return_inverse=True)
                    row[once] = np.minimum(row[once] + np.bincount(back, n).astype(np.int64), most)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                once: set[bytes] = set()
                for piece in terms(text.as_py()):
                    once.update(piece)
                seen = held.setdefault(lang, Counter())
                size -= len(seen)
                seen.update(once)
                size += len(seen)
                if size > HELD:
                    flush()
                    size = 0
        flush()
        own = min(BLOCK, 1 << bits)
        for i, block in enumerate(cells.reshape(-1, own)):
            if block.any():
                yield pa.RecordBatch.from_pydict({"slot": pa.array([i], pa.int32()), "cells": pa.array([_packed(block)], pa.binary())})

    return run


def _merged(bits: int, most: int, last: bool):
    """Blocks, sorted by slot and salt, to one for each; at last to a bit for each cell: whether it has reached the limit."""

    def run(batches):
        at, total = None, None

        def done():
            out = np.packbits(total >= most).tobytes() if last else _packed(total)
            return pa.RecordBatch.from_pydict({"slot": pa.array([at[0]], pa.int32()), "cells": pa.array([out], pa.binary())})

        for batch in batches:
            for slot, salt, raw in zip(*(batch.column(c).to_pylist() for c in ("slot", "salt", "cells")), strict=True):
                if (slot, salt) != at:
                    if at is not None:
                        yield done()
                    at, total = (slot, salt), np.zeros(min(BLOCK, 1 << bits), np.min_scalar_type(most))
                _add(total, raw, most)
        if at is not None:
            yield done()

    return run


def sketch(texts: DataFrame, bits: int, min_docs: int) -> np.ndarray:
    """A bit for each cell of the merged sketch of ``texts`` (lang, text): set if some term of the cell may be in ``min_docs`` documents.

    At most ROWS * 2 ** 24 bits, 8 MB, reach the driver.
    """
    blocks, schema = texts.mapInArrow(_sketches(bits, min_docs), "slot int, cells binary"), "slot int, cells binary"
    for last, salt in ((False, F.spark_partition_id() % SALTS), (True, F.lit(0))):
        dealt = blocks.withColumn("salt", salt).repartition("slot", "salt").sortWithinPartitions("slot", "salt")
        blocks = dealt.mapInArrow(_merged(bits, min_docs, last), schema)
    own = min(BLOCK, 1 << bits) // 8
    out = np.zeros((ROWS << bits) // (8 * own), f"V{own}")
    for slot, cells in blocks.collect():
        out[slot] = np.frombuffer(bytes(cells), f"V{own}")[0]
    return out.view(np.uint8).reshape(ROWS, -1)


def possible(marks: np.ndarray, bits: int, lang: str, found: list[bytes]) -> np.ndarray:
    """Of terms of a language, which the sketch lets through."""
    at = _places(lang, found, bits)
    return np.all([row[a >> 3] >> (7 - (a & 7)).astype(np.uint8) & 1 for row, a in zip(marks, at, strict=True)], axis=0)


def _counted(bits: int, marks):
    """Texts (lang, source, text) to (lang, source, term, n, docs) of the terms that the sketch lets through."""

    def run(batches):
        for found, groups, group, term, n, docs in _tallies(batches):
            kept = np.zeros(len(group), bool)
            lang_of = np.array([lang for lang, _ in groups], object)[group]
            for lang in {lang for lang, _ in groups}:
                own = np.flatnonzero(lang_of == lang)
                some = np.unique(term[own])
                ok = np.zeros(len(found), bool)
                ok[some] = possible(marks.value, bits, lang, [found[j] for j in some.tolist()])
                kept[own] = ok[term[own]]
            at = pa.array(group[kept])
            columns = {"lang": pa.array([lang for lang, _ in groups], pa.string()).take(at), "source": pa.array([source for _, source in groups], pa.string()).take(at)}
            columns |= {"term": pa.array(found, pa.binary()).take(pa.array(term[kept])).cast(pa.string()), "n": pa.array(n[kept]), "docs": pa.array(docs[kept], pa.int64())}
            batch = pa.RecordBatch.from_pydict(columns)
            yield from (batch.slice(i, HANDED) for i in range(0, batch.num_rows, HANDED))

    return run


def _share(n: str, total: str) -> Column:
    return F.expr(f"1 + cast({UNIT} as decimal(10,0)) * ({n} + 2) div ({total} + 2 * n_kept)")


def _f(p: str, q: str) -> str:
    """SQL of the divergence of two shares; they are at most UNIT + 1, so its square fits a long."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """How sources of a language differ: lang, source, part, item, value, rank.

    Part ``pair`` has a row for each other source of the language, ``term`` the ``top`` terms that mark the source against its
    whole language. Rank follows the value, largest first, then the item in UTF-8 order. Null texts, languages and sources
    are empty ones; a text without terms counts as a document of its group; rows that repeat are documents of their own; very
    long texts are taken apart piece by piece. A language without any kept term has pairs of value 0. An empty table gives an
    empty one; other columns are ignored. A pair's join has a row for each term that both sources have.
    """
    if min_docs < 1:
        raise ValueError("min_docs must be positive")
    scratch = Scratch(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text"))
    found = scratch.cut(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    size = found.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(max((size // 1024).bit_length(), CELLS[0]), CELLS[1])
    marks = docs.sparkSession.sparkContext.broadcast(sketch(rows.select("lang", "text"), bits, min_docs))
    each = rows.mapInArrow(_counted(bits, marks), "lang string, source string, term string, n long, docs long")
    counts = scratch.cut(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = scratch.cut(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).drop("docs"))
    own = scratch.cut(counts.drop("docs").join(kept, ["lang", "term"]))

    langs = kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("n_lang").alias("lang_total"))
    sizes = own.groupBy("lang", "source").agg(F.count("*").alias("here"), F.sum("n").alias("total"))
    groups = found.drop("bytes").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = scratch.cut(groups.withColumn("p0", F.when(F.col("n_kept") > 0, _share("0", "total")).otherwise(F.lit(1).cast("long"))))
    shares = own.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", _share("n", "total").alias("p"), _share("n_lang", "lang_total").alias("q"))
    shares = scratch.cut(shares)

    left, right = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("p0").alias(f"p0_{s}")) for s in "ab")
    more = F.expr(f"{_f('p_a', 'p_b')} - {_f('p_a', 'p0_b')} - {_f('p0_a', 'p_b')} + {_f('p0_a', 'p0_b')}")
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", more.alias("value"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    alone = levels.join(others, "lang").where("source <> other").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.expr(f"n * {_f('p', 'other_p0')}").alias("value"))
    ga, gb = (groups.select("lang", *([F.col("n_kept")] if s == "a" else []), F.col("source").alias(s), F.col("here").alias(f"here_{s}"), F.col("p0").alias(f"p0_{s}")) for s in "ab")
    rest = ga.join(gb, "lang").where("a < b").select("lang", "a", "b", F.expr(f"(n_kept - here_a - here_b) * {_f('p0_a', 'p0_b')}").alias("value"))
    once = both.unionByName(alone).unionByName(rest).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = once.select("lang", way.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    marked = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(marked.withColumn("rank", rank).where(F.col("rank") <= top))
