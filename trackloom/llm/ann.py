"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are told from the nearest of some centres, scaled to length one, cut into parts of two components, and each part is
coded by one of 16 centres of its own (four bits); so codes are as fine as what is left in a cluster, whatever its size and
the vectors' norms. The loss that fits the centres and chooses the codes weighs the part of the residual that is parallel
to the vector higher than the rest, because that part changes the scores that matter in a search for the largest inner
products. What the codes leave is kept in a byte a component. The codebooks are fitted on a bounded sample; every vector is
coded once, and codes and bytes (one and a quarter a component) are the index that is written. A query adds up one table
entry for each part, over a block of codes. Entries that could be among its nearest, by the error that the codes turn out to
have for this query, are scored again with their bytes, as many as there are; a block's best go on by their number alone.
The best of all blocks meet their original vectors in one equi-join and are scored exactly, in double precision.

Equal vectors are one entry of the index, with as many of their smallest ids as a result can hold, so a vector that a third
of the rows share costs one entry and its ids tie as they should.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

TOP = 20
#: Vectors that the codebooks are fitted on, drawn by a hash: the bound of the sample.
SAMPLE = 8192
#: Centres that vectors are told from, at most; fewer of a small sample.
CELLS = 256
PART, CENTRES = 2, 16
#: Codes of a block (more, where there would be over MAX_BLOCKS of them), and queries of a block.
BLOCK, MAX_BLOCKS, QUERY_BLOCK = 16384, 1024, 1024
#: Entries that are scored exactly for each query: so many for each doubling of the index's size.
RERANK = 24
#: Scores over this share of the norm weigh in the loss.
THRESHOLD = 0.2
#: Deviations of the codes' error that an entry may be short of a query's nearest and still be scored by its bytes.
DEVIATIONS = 4.0


class Codebooks:
    """Centres of each part, and the weight of the parallel residual."""

    def __init__(self, dim: int, centres: list[np.ndarray]):
        self.dim, self.centres, self.cells = dim, centres, np.zeros((1, dim))
        self.parts = [(at, min(at + PART, dim)) for at in range(0, dim, PART)]
        self.eta = max(1.0, THRESHOLD**2 / (1 - THRESHOLD**2) * (dim - 1))

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n, parts) by coordinate descent on the anisotropic loss."""
        norm = np.maximum((x * x).sum(axis=1), 1e-30)
        codes = np.stack([((x[:, a:b, None] - c.T[None]) ** 2).sum(axis=1).argmin(axis=1) for (a, b), c in zip(self.parts, self.centres, strict=True)], axis=1)
        dots = [x[:, a:b] @ c.T for (a, b), c in zip(self.parts, self.centres, strict=True)]
        own = [(x[:, a:b] ** 2).sum(axis=1) for a, b in self.parts]
        rows = np.arange(len(x))
        along = sum(o - d[rows, codes[:, j]] for j, (o, d) in enumerate(zip(own, dots, strict=True)))
        for _ in range(passes):
            for j, c in enumerate(self.centres):
                along = along - (own[j] - dots[j][rows, codes[:, j]])
                plain = own[j][:, None] - 2 * dots[j] + (c * c).sum(axis=1)[None]
                loss = plain + (self.eta - 1) * (along[:, None] + own[j][:, None] - dots[j]) ** 2 / norm[:, None]
                codes[:, j] = loss.argmin(axis=1)
                along = along + own[j] - dots[j][rows, codes[:, j]]
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, pairs of parts, 256): what a byte of two codes adds to a query's score."""
        t = np.stack([q[:, a:b] @ c.T for (a, b), c in zip(self.parts, self.centres, strict=True)], axis=1)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], axis=1)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES).astype(np.float32)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest of ``cells`` to each vector."""
        half = (self.cells * self.cells).sum(axis=1) / 2
        return np.concatenate([np.argmax(x[at : at + BLOCK] @ self.cells.T - half, axis=1) for at in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, np.int64)

    def entries(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each vector: its cell, its distance from it (scale), codes, and what they leave: ``unit`` times bytes."""
        cell = self.cell(x)
        left = x - self.cells[cell]
        scale = np.linalg.norm(left, axis=1)
        codes = self.encode(left / np.maximum(scale, 1e-300)[:, None])
        coded = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.centres)], axis=1)
        left = left - scale[:, None] * coded
        unit = np.abs(left).max(axis=1) / 127
        return cell, scale, codes, unit, np.rint(left / np.maximum(unit, 1e-300)[:, None]).astype(np.int8)

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
        return codes[:, 0::2] * CENTRES + codes[:, 1::2]


def fit(x: np.ndarray, rounds: int = 8, seed: int = 5) -> Codebooks:
    """Codebooks of the sample ``x``, by alternating codes and weighted least-squares centres."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    books = Codebooks(dim, [])
    books.centres = [x[rng.integers(len(x), size=CENTRES), a:b].copy() for a, b in books.parts]
    norm = np.maximum((x * x).sum(axis=1), 1e-30)
    weight = (books.eta - 1) / norm
    for _ in range(rounds):
        codes = books.encode(x, passes=1)
        rows = np.arange(len(x))
        along = sum((x[:, a:b] * (x[:, a:b] - c[codes[:, j]])).sum(axis=1) for j, ((a, b), c) in enumerate(zip(books.parts, books.centres, strict=True)))
        for j, (a, b) in enumerate(books.parts):
            part, code, c = x[:, a:b], codes[:, j], books.centres[j]
            rest = along - (part * (part - c[code])).sum(axis=1)
            goal = rest + (part * part).sum(axis=1)  # what the centre's product with the vector should be
            for k in range(CENTRES):
                m = code == k
                if m.any():
                    p, w = part[m], weight[m]
                    left = m.sum() * np.eye(b - a) + (p * w[:, None]).T @ p
                    c[k] = np.linalg.solve(left, p.sum(axis=0) + (p * (w * goal[m])[:, None]).sum(axis=0))
            along = rest + (part * (part - c[code])).sum(axis=1)
    return books


def cells_of(x: np.ndarray, most: int = CELLS, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """Centres of the sample ``x`` by k-means, one for 32 vectors, ``most`` at most."""
    books = Codebooks(x.shape[1], [])
    books.cells = x[np.random.default_rng(seed).permutation(len(x))[: min(most, max(1, len(x) // 32))]].copy()
    for _ in range(rounds):
        cell = books.cell(x)
        n = np.bincount(cell, minlength=len(books.cells))
        total = np.zeros_like(books.cells)
        np.add.at(total, cell, x)
        books.cells[n > 0] = total[n > 0] / n[n > 0, None]
    return books.cells


def fit_index(x: np.ndarray) -> Codebooks:
    """Cells of the sample ``x``, and codebooks of what its vectors, told from their cells, have of length one."""
    finder = Codebooks(x.shape[1], [])
    finder.cells = cells_of(x)
    left = x - finder.cells[finder.cell(x)]
    books = fit(left / np.maximum(np.linalg.norm(left, axis=1), 1e-300)[:, None])
    books.cells = finder.cells
    return books


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: What the index holds of an entry.
CODED = "entry long, cell int, scale double, unit double, codes binary, fine binary"


def _encode(books: Codebooks):
    def run(batches):
        for batch in batches:
            cell, scale, codes, unit, fine = books.entries(_matrix(batch.column("v"), books.dim))
            both = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (Codebooks.pack(codes), fine)]
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(cell, pa.int32()), pa.array(scale), pa.array(unit), *both], names=["entry", "cell", "scale", "unit", "codes", "fine"])

    return run


def nearest_of_block(books: Codebooks, q: np.ndarray, index: tuple[np.ndarray, ...], best: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``best`` entries of a block for each query, by codes first and bytes then.

    ``index``: cell, scale, packed codes, unit and bytes of the entries. Whatever the codes alone place so close to the
    last of the ``top`` that their error could hide it is scored by its bytes; no number limits how many.
    """
    cell, scale, packed, unit, fine = index
    far = np.sqrt(np.einsum("ij,ij->i", fine, fine, dtype=np.float64)) * unit  # length of what the codes leave
    middle, tables = q @ books.cells.T, books.tables(q)
    score = np.zeros((len(q), len(cell)), np.float32)
    for j in range(packed.shape[1]):
        score += tables[:, j, :][:, packed[:, j]]
    places, scores = np.empty((len(q), best), np.int64), np.empty((len(q), best))
    some = np.arange(min(256, len(cell)))  # entries are dealt by a hash, so any are as good as drawn
    for i in range(len(q)):
        near = middle[i][cell] + scale * score[i]
        off = lambda k, v=q[i].astype(np.float32): unit[k] * (fine[k].astype(np.float32) @ v)
        first = np.argpartition(-near, best - 1)[:best]
        known = np.concatenate([first, some])
        known = known[far[known] > 0]
        errors = off(known) / far[known]
        spread = np.sqrt(np.mean(errors * errors)) if len(errors) else 0.0
        last = np.partition(near[first] + off(first), best - min(top, best))[best - min(top, best)]
        near_enough = near + DEVIATIONS * spread * far >= last
        near_enough[first] = True
        kept = np.flatnonzero(near_enough)
        again = near[kept] + off(kept)
        chosen = np.argpartition(-again, best - 1)[:best]
        places[i], scores[i] = kept[chosen], again[chosen]
    return places, scores


def _scan(books: Codebooks, rerank: int, top: int):
    schema = pa.schema([("query_id", pa.int64()), ("entry", pa.int64()), ("near", pa.float64())])

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        """The best ``rerank`` entries of one block of codes for each query of one block."""
        if not index.num_rows or not asked.num_rows:
            return schema.empty_table()
        entry, query = index["entry"].to_numpy(), asked["query_id"].to_numpy()
        cell, scale, unit = (index[c].to_numpy() for c in ("cell", "scale", "unit"))
        packed, fine = (np.frombuffer(b"".join(index[c].to_pylist()), kind).reshape(len(entry), -1) for c, kind in (("codes", np.uint8), ("fine", np.int8)))
        q, best = _matrix(asked["v"], books.dim), min(rerank, len(entry))
        q /= np.abs(q).max(axis=1, keepdims=True)  # a query's length changes no order
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), 64):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for low in range(0, len(entry), BLOCK):
                own = tuple(a[low : low + BLOCK] for a in (cell, scale, packed, unit, fine))
                places, scores = nearest_of_block(books, q[at : at + 64], own, min(best, len(own[0])), top)
                held.append((places + low, scores))
            place, near = (np.concatenate(x, axis=1) for x in zip(*held, strict=True))
            found = np.argpartition(-near, best - 1, axis=1)[:, :best]
            out.append((np.repeat(query[at : at + 64], best), entry[np.take_along_axis(place, found, 1)].ravel(), np.take_along_axis(near, found, 1).ravel()))
        return pa.Table.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out, strict=True)], schema=schema)

    return run


def _exact(dim: int):
    def run(batches):
        for batch in batches:
            x, q = (_matrix(batch.column(c), dim) for c in ("v", "q"))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array((x * q).sum(axis=1))], names=["query_id", "ids", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that take part, with their own kind of components: of the most frequent length, finite, none null, not all zero."""
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding") if kind == T.ArrayType(T.FloatType()) else F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda e: e != 0))
    length = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    dims = length.first()  # one row
    return ok.where(F.size("v") == (dims[0] if dims else 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE, block: int = BLOCK, rerank: int = RERANK) -> DataFrame:
    """The ``top`` nearest rows of ``vectors`` for each of ``queries``: query_id, rank, vec_id, score.

    Both have vec_id and embedding. A query's own vec_id is no candidate; ties go to the smaller vec_id; fewer candidates
    than ``top`` are all returned. Vectors null, zero, with null or non-finite components or of an odd length take no part,
    nor do null ids. Of rows that repeat a vec_id with another vector, each is a candidate and the least vector is asked.
    Empty tables give an empty result; other columns are ignored. ``rerank`` entries for each doubling of the index's size,
    and never under ``top`` + 1, are scored exactly.
    """
    scratch = Scratch(vectors.sparkSession)
    good = scratch.cut(usable(vectors))
    first = good.first()
    dim = len(first[1]) if first else PART
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    index = good.distinct().withColumn("rank", rank).where(F.col("rank") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = scratch.cut(index.withColumn("entry", F.monotonically_increasing_id()))
    n = index.count()
    drawn = F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))) + 1
    x = np.array([r[0] for r in index.where(drawn).select("v").limit(2 * sample).collect()], np.float64).reshape(-1, dim)
    books = fit_index(x) if len(x) else Codebooks(dim, [np.zeros((CENTRES, min(PART, dim - a))) for a in range(0, dim, PART)])
    codes = scratch.cut(index.select("entry", "v").mapInArrow(_encode(books), CODED))
    asked = good.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch.cut(asked.withColumnRenamed("vec_id", "query_id"))
    blocks, query_blocks = max(1, -(-n // max(block, -(-n // MAX_BLOCKS)))), max(1, -(-asked.count() // QUERY_BLOCK))
    left = codes.withColumn("b", F.pmod(F.xxhash64("entry"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    most = max(top + 1, rerank * max(1, n).bit_length())
    # blocks are dealt by a hash, so a block's share of the best is known up to a few deviations
    share = most if blocks == 1 else min(most, math.ceil(most / blocks + 4 * math.sqrt(most / blocks) + 4))
    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(_scan(books, share, top + 1), "query_id long, entry long, near double")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "entry")
    kept = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("query_id", "entry")
    both = kept.join(index, "entry").join(asked.select("query_id", F.col("v").alias("q")), "query_id").select("query_id", "ids", "v", "q")
    found = both.mapInArrow(_exact(dim), "query_id long, ids array<bigint>, score double")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
