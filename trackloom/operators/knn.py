"""Exact search for many queries at once: a k-nearest-neighbour join of two tables of vectors.

The index is cut into cells around pivots, each vector in that of its nearest pivot. A cell has a ring, from the least to
the largest distance of its members to the pivot, so by the triangle inequality no member is nearer to a query than the query's own distance to the
ring. A query first searches the nearest cells that hold k vectors; the k-th distance found there bounds it, and of the others it
visits only those whose ring comes within that bound. In a visited cell the same inequality passes over single vectors.

Queries and cells meet in blocks of bounded size: a cell with very many vectors is split into parts, and the queries that visit
it into groups, so neither a hot cell nor a hot query region lands in one task. Each block hands on at most k rows for a query, and a
ranked merge keeps the k of all. What reaches the driver is bounded by the number of pivots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULTS
from ..sources.files import settle

#: The most pivots, vectors sampled for each of them, vectors of a cell and queries that one block holds.
PIVOTS, SAMPLED, TOGETHER, QUERIES = 1024, 4, 4096, 1024
#: Slack of the bounds, for rounding.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Of sampled vectors, n that lie far apart: each the farthest from those before it; fewer, if fewer differ."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def usable(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn(vector, v).where(F.coalesce((F.size(v) == dim) & ~bad, F.lit(False)))


def _assigned(pivots):
    """Vectors (v, ...) with their cell and distance to its pivot."""

    def run(batches):
        p = pivots.value
        half = (p * p).sum(axis=1) / 2
        for b in batches:
            x = _matrix(b.column("v"), p.shape[1])
            cell = (half - x @ p.T).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            r = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r, pa.float64())], names=[*b.schema.names, "cell", "r"])

    return run


def _visits(pivots, cells: np.ndarray, count: np.ndarray, near: np.ndarray, far: np.ndarray, k: int, first: bool):
    """Queries (qn, v, bound) to the cells that they visit, first or later, with their distance to the pivot."""

    def run(batches):
        p = pivots.value[cells]
        for b in batches:
            qn, at, d = [], [], []
            for n, q, bound in zip(b.column("qn").to_pylist(), _matrix(b.column("v"), p.shape[1]), b.column("bound").to_pylist(), strict=True):
                to = np.sqrt(((p - q) ** 2).sum(axis=1))
                least = np.maximum(np.maximum(to - far, near - to), 0)
                order = np.lexsort((to, least))
                home = order[: int(np.searchsorted(np.cumsum(count[order]), k)) + 1]
                if first:
                    some = home
                else:
                    some = np.flatnonzero(least <= (np.inf if bound is None else bound * (1 + SLACK) + SLACK))
                    some = some[~np.isin(some, home)]
                qn += [n] * len(some)
                at.append(cells[some])
                d.append(to[some])
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (at, d)]
            yield pa.RecordBatch.from_arrays([pa.array(qn, pa.int64()), pa.array(flat[0].astype(np.int32)), pa.array(flat[1], pa.float64())], names=["qn", "cell", "d"])

    return run


def _nearest(k: int, dim: int, schema: pa.Schema):
    """A group of queries (qn, v, bound, d) and a part of the cell that they visit (id, row, r, v) to the k nearest of each."""

    def run(queries: pa.Table, part: pa.Table) -> pa.Table:
        if not queries.num_rows or not part.num_rows:
            return schema.empty_table()
        x, r, ids, row = _matrix(part["v"], dim), part["r"].to_numpy(), part["id"].to_pylist(), part["row"].to_pylist()
        rows = []
        for n, q, bound, d in zip(queries["qn"].to_pylist(), _matrix(queries["v"], dim), queries["bound"].to_pylist(), queries["d"].to_pylist(), strict=True):
            most = np.inf if bound is None else bound * (1 + SLACK) + SLACK
            some = np.flatnonzero(np.abs(r - d) <= most)
            if not len(some):
                continue
            far = np.sqrt(((x[some] - q) ** 2).sum(axis=1))
            if len(far) > k:
                most = min(most, np.partition(far, k - 1)[k - 1])
            rows += [(n, i, at, a) for a, i, at in sorted((float(far[j]), ids[some[j]], row[some[j]]) for j in np.flatnonzero(far <= most))[:k]]
        return pa.Table.from_arrays([pa.array([x[c] for x in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("qn").orderBy("distance", "id", "row"))
    return found.withColumn("rank", n).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame, index: DataFrame, k: int = DEFAULTS.top_k, query_id: str = "query_id", id_col: str = "track_id", vector: str = "embedding", where: dict[str, object] | None = None, pivots: int | None = None, keep: tuple[str, ...] = (), report: dict | None = None
) -> DataFrame:
    """The k rows of ``index`` nearest to each row of ``queries``: (query_id, id_col, distance, similarity, rank), and the columns ``keep`` of the index.

    Exact; ties by id, which isn't null. Filters name columns of the index and hold before the search. Vectors that are null, hold a null or a value
    that isn't finite, or are not of the index's most frequent length take no part. A query finds fewer than k rows only if there are
    fewer; rows that repeat are found each for itself. ``pivots`` defaults to the root of the index's size. ``report`` gets
    cells, queries and visits: how many cells there are and how often one was visited.
    """
    spark = index.sparkSession
    for key, value in (where or {}).items():
        index = index.where((F.col(key) if key in index.columns else F.try_element_at("metadata", F.lit(key))) == F.lit(value))
    kinds = {f.name: f.dataType for f in [*queries.schema, *index.schema]}
    out = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, kinds[id_col]), T.StructField("distance", T.DoubleType()), T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType()), *[index.schema[c] for c in keep]])
    sizes = index.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if report is not None:
        report.update(cells=0, queries=0, visits=0)
    if sizes is None or not sizes["dim"]:
        return spark.createDataFrame([], out)
    dim, n = sizes["dim"], sizes["count"]
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")
    rows = usable(index.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), kept.alias("kept")), "v", dim)
    m = pivots or max(1, min(PIVOTS, round(n**0.5)))
    draw = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < int(min(1.0, 2 * SAMPLED * m / n) * (1 << 30))).orderBy("draw").limit(SAMPLED * m).select("v").collect()
    drawn = drawn or rows.select("v").limit(1).collect()
    if not drawn:
        return spark.createDataFrame([], out)
    center = spark.sparkContext.broadcast(spread_pivots(np.array([r["v"] for r in drawn]), m))

    fields = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    placed = settle(rows.mapInArrow(_assigned(center), fields).withColumn("row", F.monotonically_increasing_id()))
    cells = sorted(placed.groupBy("cell").agg(F.count("*"), F.min("r"), F.max("r")).collect())  # at most one row a pivot
    cell, count, near, far = (np.array(c) for c in zip(*cells, strict=True))
    parts = np.ones(len(center.value), np.int64)
    parts[cell] = -(-count // TOGETHER)
    of_cell = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), of_cell(parts)))
    asked = usable(queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("v")), "v", dim)
    asked = settle(asked.withColumn("qn", F.monotonically_increasing_id()))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("qn", T.LongType()), T.StructField("id", kinds[id_col]), T.StructField("row", T.LongType()), T.StructField("distance", T.DoubleType())])

    def searched(bounded: DataFrame, first: bool) -> DataFrame:
        visits = bounded.select("qn", "v", "bound").mapInArrow(_visits(center, cell, count, near, far, k, first), "qn long, cell int, d double")
        visits = settle(visits)
        groups = np.ones(len(center.value), np.int64)
        for c, times in visits.groupBy("cell").count().collect():  # at most one row a pivot
            groups[c] = -(-times // QUERIES)
            if report is not None:
                report["visits"] += times
        group = F.pmod(F.xxhash64("qn"), of_cell(groups)).alias("group")
        part = F.explode(F.sequence(F.lit(0).cast("long"), of_cell(parts) - 1)).alias("part")
        key = ["cell", "part", "group"]
        left = visits.join(bounded.select("qn", "v", "bound"), "qn").select("qn", "v", "bound", "d", "cell", group, part)
        copies = F.explode(F.sequence(F.lit(0).cast("long"), of_cell(groups) - 1)).alias("group")
        seen = visits.select("cell").distinct()
        right = placed.join(seen, "cell", "left_semi").select("id", "row", "r", "v", "cell", "part", copies)
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k, dim, to_arrow_schema(schema)), schema)
        return settle(_ranked(found, k).drop("rank"))

    begun = searched(asked.withColumn("bound", F.lit(None).cast("double")), True)
    bounds = begun.groupBy("qn").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    more = searched(asked.join(bounds, "qn", "left"), False)
    if report is not None:
        report.update(cells=len(cells), queries=asked.count())
    best = _ranked(begun.unionByName(more), k).join(asked.select("qn", "qid"), "qn")
    if keep:
        best = best.join(placed.select("row", "kept"), "row")
    return best.select(F.col("qid").alias(query_id), F.col("id").alias(id_col), "distance", (1 / (1 + F.col("distance"))).alias("similarity"), "rank", *[F.col(f"kept.{c}") for c in keep])
