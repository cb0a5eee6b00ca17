"""All registered queries over the stand-in tables, each with its oracle where SQL can express it.

No table holds real tracks: ``events`` stands for the tracking table, ``embeddings`` for identities, texts for OCR tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import vectors as V
from .operators import embeddings as E
from .operators import cache, graph, knn, places, projection, search, stats, tracks, windows
from .operators.cache import read_through
from .plans import agent
from .plans import pipeline as chains
from .schemas import Intrinsics
from .sinks.files import TrackWriter, write_manifest, write_point_cloud, write_trajectory_parts
from .sources import generators as gen
from .sources.files import TrackStore, read_point_cloud, read_trajectory_parts, settle, work_dir
from .streaming import frames as streams
from .streaming import fusion, stitching
from .streaming.pca import IncrementalPCA
from .udf import StubDepth, StubEmbedder, StubTracker, apply_model, apply_per_clip

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins, in both languages.


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    z = F.when(F.col("event_id") % 17 == 0, 0.0).otherwise((F.col("event_id") % 50) / 10 + 0.5)
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.get_json_object("props", "$.k").cast("double").alias("x"),
        F.col("value").alias("y"), z.alias("z"), ((F.col("event_id") % 100) / 100).alias("confidence"), F.col("event_type").alias("class_name"), "event_id",
    )


T = """WITH tracking AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS x, value AS y, CASE WHEN event_id % 17 = 0 THEN 0e0 ELSE CAST(event_id % 50 AS DOUBLE) / 10e0 + 5e-1 END AS z,
 CAST(event_id % 100 AS DOUBLE) / 100e0 AS confidence, event_type AS class_name, event_id FROM events)"""
W, H = 128, 96
#: A depth map by rule: every pixel of every frame.
_DEPTH = "CASE WHEN (u + v) % 13 = 0 THEN 0e0 ELSE CAST((u * 7 + v * 3 + frame_idx) % 40 AS DOUBLE) / 4e0 + 5e-1 END"


def depth_maps(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """A map for each of the given frames: (frame_idx, height, width, depth)."""
    z = f"if((i % {W} + i div {W}) % 13 = 0, 0D, ((i % {W}) * 7 + (i div {W}) * 3 + frame_idx) % 40 / 4D + 0.5D)"
    depth = F.expr(f"transform(sequence(0, {H * W - 1}), i -> cast({z} as float))")
    return frames.select("frame_idx").distinct().select("frame_idx", F.lit(H).alias("height"), F.lit(W).alias("width"), depth.alias("depth"))


K = Intrinsics.of_size(H, W)


@query(f"""{T}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM tracking WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx))
 SELECT track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS num_frames, round(avg(z), 6) AS mean_depth, round(avg(confidence), 6) AS mean_confidence,
 round(coalesce(sum(step), 0e0), 4) AS path_length FROM s GROUP BY track_id""")
def track_summary(spark, sf_dir):
    s = tracks.track_summary(tracking(spark, sf_dir))
    return s.select("track_id", "first_frame", "last_frame", "num_frames", F.round("mean_depth", 6).alias("mean_depth"), F.round("mean_confidence", 6).alias("mean_confidence"), F.round("path_length", 4).alias("path_length"))


@query(f"{T} SELECT track_id, frame_idx, x, y, z, confidence FROM tracking WHERE track_id = 7")
def track_location(spark, sf_dir):
    return tracks.track_locations(tracking(spark, sf_dir), 7)


@query(f"{T} SELECT track_id, frame_idx, x, y, z, confidence FROM tracking WHERE track_id = 7 AND frame_idx = 5")
def track_location_frame(spark, sf_dir):
    return tracks.track_locations(tracking(spark, sf_dir), 7, 5)


@query(f"""{T}, wanted AS (SELECT CAST(unnest([1, 2, 3, 100000000]) AS BIGINT) AS track_id) SELECT w.track_id, count(t.track_id) > 0 AS found,
 CASE WHEN count(t.track_id) > 0 THEN count(*) FILTER (WHERE t.frame_idx = 5) ELSE -1 END AS num_frames,
 coalesce(sum(t.frame_idx) FILTER (WHERE t.frame_idx = 5), 0)::BIGINT AS frame_sum FROM wanted w LEFT JOIN tracking t USING (track_id) GROUP BY w.track_id""")
def track_answers(spark, sf_dir):
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 100_000_000)], "track_id long")
    a = tracks.track_answer(tracking(spark, sf_dir), wanted, 5)
    return a.select("track_id", "found", F.coalesce("num_frames", F.lit(-1)).alias("num_frames"), F.aggregate("locations", F.lit(0).cast("long"), lambda s, x: s + x["frame_idx"]).alias("frame_sum"))


@query(f"{T} SELECT track_id, frame_idx, event_id FROM tracking WHERE class_name = 'click' AND frame_idx = 3")
def class_filter(spark, sf_dir):
    return tracks.of_class(tracking(spark, sf_dir), "click", 3).select("track_id", "frame_idx", "event_id")


@query("SELECT iy * 64 + ix AS id, CAST(ix * 20 AS FLOAT) AS x, CAST(iy * 20 AS FLOAT) AS y FROM range(36) a(iy), range(64) b(ix)")
def grid_points(spark, sf_dir):
    return gen.grid_points(spark, 720, 1280, 20)


@query("SELECT 0e0 AS frame, CAST(ix * 20 AS FLOAT) AS x, CAST(iy * 20 AS FLOAT) AS y FROM range(5) a(iy), range(7) b(ix)")
def grid_queries(spark, sf_dir):
    return gen.start_queries(gen.grid_points(spark, 100, 140, 20))


@query("""SELECT f AS frame_idx, iy * 7 + ix AS track_id, CAST(ix * 20 + f * 2.5e0 AS FLOAT) AS x, CAST(iy * 20 + f * 2.5e0 AS FLOAT) AS y, true AS visible
 FROM range(5) a(iy), range(7) b(ix), range(30) c(f)""")
def linear_tracks(spark, sf_dir):
    return gen.linear_tracks(gen.grid_points(spark, 100, 140, 20), 30)


@query("""SELECT t AS track_id, f AS frame_idx, CAST(100 + 300e0 * f / 299e0 + (t - 1) * 100 AS FLOAT) AS x, CAST(150 + 150e0 * f / 299e0 + (t - 1) * 100 AS FLOAT) AS y,
 CAST(5 AS FLOAT) AS z, '' AS ocr_text, CAST(1 AS FLOAT) AS confidence FROM range(1, 3) a(t), range(300) b(f)""")
def mock_tracks(spark, sf_dir):
    return gen.mock_tracks(spark)


_PROJECT = f"""{T}, pt AS (SELECT frame_idx, track_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y,
 CAST(greatest(0, least(round_even(CAST(x AS FLOAT), 0), {W - 1})) AS BIGINT) AS u, CAST(greatest(0, least(round_even(CAST(y AS FLOAT), 0), {H - 1})) AS BIGINT) AS v FROM tracking),
 d AS (SELECT *, CAST({_DEPTH} AS FLOAT) AS z FROM pt)"""


@query(f"""{_PROJECT} SELECT frame_idx AS frame_id, track_id AS point_id, round(CAST((x - 64) * z / 128 AS DOUBLE), 3) + 0e0 AS X, round(CAST((y - 48) * z / 128 AS DOUBLE), 3) + 0e0 AS Y,
 round(CAST(z AS DOUBLE), 3) AS Z, z > 0 AS valid FROM d""")
def project_points(spark, sf_dir):
    t = tracking(spark, sf_dir).withColumns({"x": F.col("x").cast("float"), "y": F.col("y").cast("float")})
    p = projection.project_to_3d(t, depth_maps(spark, t), H, W)
    return p.select("frame_id", "point_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in "XYZ"], "valid")


@query(f"{_PROJECT} SELECT frame_idx, count(*) AS points, count(*) FILTER (WHERE z > 0) AS valid_points FROM d GROUP BY frame_idx")
def valid_mask(spark, sf_dir):
    t = tracking(spark, sf_dir).withColumns({"x": F.col("x").cast("float"), "y": F.col("y").cast("float")})
    p = projection.project_to_3d(t, depth_maps(spark, t), H, W)
    return p.groupBy(F.col("frame_id").alias("frame_idx")).agg(F.count("*").alias("points"), F.count_if("valid").alias("valid_points"))


_BOX = "doc_id % 8 AS frame_idx, text, CAST(n_chars % 90 AS INT) AS bx, CAST(n_chars % 70 AS INT) AS b_y, CAST(n_chars % 21 AS INT) AS bw, CAST(n_chars % 15 AS INT) AS bh, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(n_chars % 101 AS DOUBLE) / 100 END AS confidence"


def detections(spark, sf_dir):
    n = F.col("n_chars")
    box = F.struct(*[(n % m).cast("int").alias(k) for k, m in (("x", 90), ("y", 70), ("w", 21), ("h", 15))])
    return _t(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 8).alias("frame_idx"), "text", box.alias("bbox"), F.when(F.col("doc_id") % 9 != 0, n % 101 / 100).alias("confidence"))


@query(f"""WITH b AS (SELECT {_BOX} FROM documents), c AS (SELECT *, bx + bw / 2e0 AS cx, b_y + bh / 2e0 AS cy FROM b WHERE confidence IS NULL OR confidence >= 0.3),
 p AS (SELECT *, CAST(greatest(0, least(round_even(cx, 0), {W - 1})) AS BIGINT) AS u, CAST(greatest(0, least(round_even(cy, 0), {H - 1})) AS BIGINT) AS v FROM c),
 d AS (SELECT *, CAST(CAST({_DEPTH} AS FLOAT) AS DOUBLE) * 2 AS z FROM p)
 SELECT frame_idx, text, round((cx - 64) * z / 128, 4) + 0e0 AS x, round((cy - 48) * z / 128, 4) + 0e0 AS y, round(z, 4) AS z, confidence, u, v FROM d WHERE z > 0""")
def attach_text_3d(spark, sf_dir):
    d = detections(spark, sf_dir)
    a = projection.attach_text(d, depth_maps(spark, spark.range(8).select(F.col("id").alias("frame_idx"))), H, W, K, 0.3, 2.0)
    return a.select("frame_idx", "text", *[F.round(f"position_3d.{c}", 4).alias(c) for c in "xyz"], "confidence", F.col("pixel_uv.u").cast("long").alias("u"), F.col("pixel_uv.v").cast("long").alias("v"))


@query(f"WITH b AS (SELECT doc_id, {_BOX} FROM documents) SELECT doc_id, CAST(trunc(bx / 1.5e0) AS INT) AS x, CAST(trunc(b_y / 1.5e0) AS INT) AS y, CAST(trunc(bw / 1.5e0) AS INT) AS w, CAST(trunc(bh / 1.5e0) AS INT) AS h FROM b")
def bbox_unscale(spark, sf_dir):
    return detections(spark, sf_dir).select("doc_id", G.unscale_bbox("bbox", 1.5).alias("b")).select("doc_id", "b.*")


@query(f"{T} SELECT event_id, CAST(floor(greatest(0, least(y * 3, 223)) / 16) * 14 + floor(greatest(0, least(x * 3, 223)) / 16) AS INT) AS patch FROM tracking")
def patch_index(spark, sf_dir):
    return tracking(spark, sf_dir).select("event_id", G.patch_index(F.col("x") * 3, F.col("y") * 3).alias("patch"))


@query(f"{T} SELECT event_id, CAST(least(frame_idx, 15) AS INT) AS slot FROM tracking")
def temporal_slot(spark, sf_dir):
    return tracking(spark, sf_dir).select("event_id", G.temporal_slot("frame_idx", 16).alias("slot"))


def _weighted(v: str):
    """All components in one number: each times its place, added up."""
    return F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query(f"""{T}, pt AS (SELECT event_id, least(frame_idx, (SELECT count(*) FROM embeddings) // 196 - 1) AS slot, floor(greatest(0, least(y * 3, 223)) / 16) * 14 + floor(greatest(0, least(x * 3, 223)) / 16) AS patch_idx FROM tracking)
 SELECT pt.event_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first, len(e.embedding) AS dim, round(list_sum([CAST(x AS DOUBLE) * i FOR x, i IN e.embedding]), 5) AS weighted FROM pt JOIN embeddings e ON e.vec_id = pt.slot * 196 + pt.patch_idx""")
def semantic_lookup(spark, sf_dir):
    t = tracking(spark, sf_dir).select(F.lit(0).alias("clip_id"), "frame_idx", F.col("event_id").alias("track_id"), (F.col("x") * 3).alias("x"), (F.col("y") * 3).alias("y"))
    e = _t(spark, sf_dir, "embeddings")
    f = e.select(F.lit(0).alias("clip_id"), F.expr("cast(vec_id div 196 as int)").alias("slot"), F.expr("cast(vec_id % 196 as int)").alias("patch_idx"), "embedding")
    return projection.semantic_lookup(t, f, e.count() // 196).select(F.col("track_id").alias("event_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"), F.round(_weighted("embedding"), 5).alias("weighted"))


@query("""WITH s AS (SELECT vec_id, [CAST(x AS DOUBLE) * 3 FOR x IN embedding] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM s)
 SELECT vec_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, round(list_sum([x / n * i FOR x, i IN v]), 5) AS weighted FROM n""")
def l2_normalize(spark, sf_dir):
    v = V.l2_normalize(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3))
    return _t(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"), F.round(_weighted("v"), 5).alias("weighted"))


@query("""SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(e), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)
 GROUP BY label, pos""")
def identity_embedding(spark, sf_dir):
    return E.identity_parts(_t(spark, sf_dir, "embeddings"), "label").withColumn("value", F.round("value", 6))


@query("""SELECT label, CAST(pos - 1 AS INT) AS pos, round(CASE WHEN sum(w) = 0 THEN avg(e) ELSE sum(w * e) / sum(w) END, 6) AS value
 FROM (SELECT label, CASE WHEN label = 3 THEN 0e0 ELSE CAST(vec_id % 7 AS DOUBLE) END AS w, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY label, pos""")
def weighted_identity(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").withColumn("weight", F.when(F.col("label") == 3, 0.0).otherwise((F.col("vec_id") % 7).cast("double")))
    return E.identity_parts(e, "label", "weight").withColumn("value", F.round("value", 6))


@query("""SELECT label AS track_id, count(*) AS vectors, round(sum(CASE WHEN vec_id % 5 = 0 THEN 0 ELSE CAST(embedding[1] AS DOUBLE) END), 4) AS first_sum FROM embeddings GROUP BY label""")
def group_by_track(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.col("label").alias("track_id"), F.col("vec_id").alias("row_idx"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("embedding"))
    g = tracks.group_by_track(e, 64)
    return g.select("track_id", F.size("embeddings").cast("long").alias("vectors"), F.round(F.aggregate("embeddings", F.lit(0.0), lambda s, v: s + v[0].cast("double")), 4).alias("first_sum"))


def flawed(spark, sf_dir):
    """Embeddings, some of which have a NaN, an infinity or a component too few."""
    rule = "case when vec_id % 11 = 3 then concat(slice(embedding, 1, 63), array(float('nan'))) when vec_id % 13 = 5 then concat(array(float('-infinity')), slice(embedding, 2, 63)) when vec_id % 17 = 1 then slice(embedding, 1, 63) else embedding end"
    return _t(spark, sf_dir, "embeddings").withColumn("embedding", F.expr(rule))


_FLAWED = """WITH f AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 3 THEN embedding[1:63] || ['nan'::FLOAT] WHEN vec_id % 13 = 5 THEN ['-infinity'::FLOAT] || embedding[2:64]
 WHEN vec_id % 17 = 1 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings), e AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS e FROM f)"""


@query(f"""{_FLAWED} SELECT round(min(e) FILTER (isfinite(e)), 6) AS min, round(max(e) FILTER (isfinite(e)), 6) AS max, round(avg(e) FILTER (isfinite(e)), 6) AS mean,
 round(stddev_pop(e) FILTER (isfinite(e)), 6) AS std, count(*) * 4 AS bytes, count(*) FILTER (isnan(e)) AS nan_count, count(*) FILTER (isinf(e)) AS inf_count FROM e""")
def embedding_stats(spark, sf_dir):
    d = E.diagnostics(flawed(spark, sf_dir))
    return d.select(*[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")], "bytes", "nan_count", "inf_count")


@query(f"""{_FLAWED}, c AS (SELECT label % 3 AS part, embedding, len([x FOR x IN embedding IF isnan(x)]) AS nans, len([x FOR x IN embedding IF isinf(x)]) AS infs FROM f WHERE vec_id % 17 <> 1 OR label % 3 = 2),
 t AS (SELECT part, count(*) = (SELECT count(*) FROM embeddings WHERE label % 3 = part AND vec_id % 17 <> 1) AS count_ok, bool_and(len(embedding) = 64) AS dim_ok, bool_and(nans = 0) AS no_nan, bool_and(infs = 0) AS no_inf FROM c WHERE part > 0 OR nans + infs = 0 GROUP BY part)
 SELECT *, count_ok AND dim_ok AND no_nan AND no_inf AS ok FROM t""")
def embedding_validate(spark, sf_dir):
    """Three parts of the table, with flaws of different kinds."""
    e, out = flawed(spark, sf_dir), None
    for part in range(3):
        own = e.where(f"label % 3 = {part}")
        n = own.where("vec_id % 17 <> 1").count()
        own = own if part == 2 else own.where("vec_id % 17 <> 1")
        own = own if part else own.where("not exists(embedding, x -> isnan(x) or abs(x) = double('infinity'))")
        got = E.validation(own, n, 64).select(F.lit(part).alias("part"), "*")
        out = got if out is None else out.unionByName(got)
    return out


def _index(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding", F.col("label").cast("string").alias("class_name"))


def _query_vector(spark, sf_dir):
    """The vector of id 0: one row."""
    return F.array(*map(F.lit, _t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]))


_D = """q AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 d AS (SELECT a.vec_id AS track_id, CAST(a.label AS VARCHAR) AS class_name, sqrt(sum(pow(a.v - b.v, 2))) AS distance FROM q a JOIN q b ON b.vec_id = 0 AND a.i = b.i GROUP BY 1, 2)"""


@query(f"WITH {_D} SELECT track_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM d ORDER BY d.distance, track_id LIMIT 10")
def knn_topk(spark, sf_dir):
    hits = search.nearest(_index(spark, sf_dir), _query_vector(spark, sf_dir), 10)
    return hits.select("track_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_D} SELECT track_id, class_name, round(distance, 6) AS distance FROM d WHERE class_name = '3' ORDER BY d.distance, track_id LIMIT 5")
def knn_filtered(spark, sf_dir):
    hits = search.nearest(_index(spark, sf_dir), _query_vector(spark, sf_dir), 5, {"class_name": "3"})
    return hits.select("track_id", "class_name", F.round("distance", 6).alias("distance"))


@query("SELECT vec_id AS track_id, coalesce(CASE WHEN vec_id % 4 <> 0 THEN 'c' || label END, 'object') || ' track_' || vec_id AS page_content FROM embeddings")
def index_documents(spark, sf_dir):
    m = F.when(F.col("vec_id") % 4 != 0, F.create_map(F.lit("class_name"), F.concat(F.lit("c"), F.col("label").cast("string")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    ids = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding", m.alias("metadata"))
    return search.index_identities(ids).select("track_id", "page_content")


@query(f"""{T}, {_D}, hits AS (SELECT * FROM d ORDER BY distance, track_id LIMIT 20),
 s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM tracking WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)),
 g AS (SELECT track_id, count(*) AS num_frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, round(coalesce(sum(step), 0e0), 4) AS path_length FROM s GROUP BY track_id)
 SELECT h.track_id, round(h.distance, 6) AS distance, g.track_id IS NOT NULL AS found, coalesce(g.num_frames, 0) AS num_frames, coalesce(g.first_frame, -1) AS first_frame, coalesce(g.last_frame, -1) AS last_frame, g.path_length, coalesce(g.num_frames, 0) AS n_locations FROM hits h LEFT JOIN g USING (track_id)""")
def agent_query(spark, sf_dir):
    a = agent.answer(_index(spark, sf_dir), tracking(spark, sf_dir), _query_vector(spark, sf_dir), 20)
    n = F.coalesce(F.size("locations"), F.lit(0)).cast("long")
    end = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_frame", "last_frame")]
    return a.select("track_id", F.round("distance", 6).alias("distance"), "found", F.coalesce("num_frames", F.lit(0)).alias("num_frames"), *end, F.round("path_length", 4).alias("path_length"), n.alias("n_locations"))


def nodes(spark, sf_dir):
    """Points of a frame as one graph."""
    t = tracking(spark, sf_dir)
    return t.select(F.col("frame_idx").alias("graph_id"), F.col("track_id").alias("node_idx"), "track_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))


_EDGES = f"""{T}, e AS (SELECT a.frame_idx AS graph_id, a.track_id AS src, b.track_id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist
 FROM tracking a JOIN tracking b ON a.frame_idx = b.frame_idx AND a.track_id <> b.track_id AND abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 8)"""


@query(f"{_EDGES} SELECT graph_id, src, dst, round(dist, 4) AS dist FROM e WHERE dist < 8")
def radius_edges(spark, sf_dir):
    pairs = places.place_pairs(places.searchable(nodes(spark, sf_dir)), 8.0)
    return places.edges_of(pairs.withColumn("dist", F.round("dist", 4)))


@query(f"{_EDGES} SELECT graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY dist, dst) AS n FROM e WHERE dist < 8) WHERE n <= 3")
def radius_edges_capped(spark, sf_dir):
    return graph.radius_edges(nodes(spark, sf_dir), 8.0, 3).select("graph_id", "src", "dst")


@query(f"{_EDGES} SELECT graph_id, src, count(*) AS degree FROM e WHERE dist < 8 GROUP BY graph_id, src")
def node_degree(spark, sf_dir):
    return places.radius_degrees(nodes(spark, sf_dir), 8.0)


@query("""SELECT vec_id AS node_idx, CASE WHEN vec_id % 3 = 0 THEN 3 + 64 ELSE 3 + len(embedding) END AS width, vec_id % 3 <> 0 AS has_embedding, vec_id % 3 <> 0 AND len([x FOR x IN embedding IF x <> 0]) > 0 AS nonzero,
 round(14e0 * vec_id + CASE WHEN vec_id % 3 = 0 THEN 0e0 ELSE list_sum([CAST(x AS DOUBLE) * (i + 3) FOR x, i IN embedding]) END, 5) AS weighted FROM embeddings""")
def ghost_nodes(spark, sf_dir):
    n = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_idx"), *[(F.col("vec_id") * n).cast("double").alias(c) for n, c in enumerate(("px", "py", "pz"), 1)], F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return graph.fusion_nodes(n, 64).select("node_idx", F.size("features").cast("long").alias("width"), "has_embedding", "nonzero", F.round(_weighted("features"), 5).alias("weighted"))


@query(f"""{T} SELECT frame_idx % 2 AS graph_id, track_id FROM tracking""")
def graph_batch(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return graph.graph_batch(n.where("graph_id % 2 = 0"), n.where("graph_id % 2 = 1")).select("graph_id", "track_id")


@query(f"{T} SELECT DISTINCT track_id FROM tracking")
def distinct_tracks(spark, sf_dir):
    return tracking(spark, sf_dir).select("track_id").distinct()


_WINDOWS = f"""{T}, c AS (SELECT track_id AS clip_id, count(*) AS n_frames FROM tracking GROUP BY track_id),
 w AS (SELECT clip_id, n_frames, unnest(range(CAST(greatest(0, ceil((n_frames - 4) / 12e0)) AS BIGINT))) AS window_id FROM c)"""


def clips(spark, sf_dir):
    return tracking(spark, sf_dir).groupBy(F.col("track_id").alias("clip_id")).agg(F.count("*").alias("n_frames"))


@query(f"{_WINDOWS} SELECT clip_id, CAST(window_id AS INT) AS window_id, CAST(window_id * 12 AS INT) AS start, CAST(least(window_id * 12 + 16, n_frames) AS INT) AS \"end\" FROM w")
def frame_windows(spark, sf_dir):
    return windows.frame_windows(clips(spark, sf_dir))


def chunks(spark, sf_dir):
    t = tracking(spark, sf_dir)
    f = t.select(F.col("track_id").alias("clip_id"), "frame_idx", (F.col("event_id") % 5).alias("track_id"), "x").join(clips(spark, sf_dir), "clip_id")
    return windows.windows_of_frames(f).withColumn("x", F.col("x") + F.col("window_id") * 1000)


@query(f"""{_WINDOWS} SELECT t.track_id AS clip_id, t.frame_idx, t.event_id % 5 AS track_id, max(w.window_id) AS window_id, max(t.x + w.window_id * 1000) AS x
 FROM tracking t JOIN w ON w.clip_id = t.track_id AND t.frame_idx >= w.window_id * 12 AND t.frame_idx < w.window_id * 12 + 16 GROUP BY ALL""")
def stitched_tracks(spark, sf_dir):
    return windows.stitch(chunks(spark, sf_dir)).select("clip_id", "frame_idx", "track_id", "window_id", "x")


@query(f"{T} SELECT track_id AS id, frame_idx AS f, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM tracking")
def trajectory_nested(spark, sf_dir):
    p = tracking(spark, sf_dir).select(F.col("frame_idx").alias("frame_id"), F.col("track_id").alias("point_id"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"))
    return tracks.trajectories(p).select("id", F.inline("path")).select("id", "f", *[F.round(c, 4).alias(c) for c in "xyz"])


@query(f"""{T}, n AS (SELECT track_id, count(*) AS n FROM tracking GROUP BY track_id), a AS (SELECT track_id, s / 2e0 AS seconds, least(CAST(floor(s / 2e0 * 30) AS BIGINT), n - 1) AS frame FROM n, range(6) r(s))
 SELECT a.track_id AS id, a.seconds, a.frame, round(t.x, 4) AS x, round(t.y, 4) AS y FROM a JOIN tracking t ON t.track_id = a.track_id AND t.frame_idx = a.frame""")
def playback_position(spark, sf_dir):
    p = tracking(spark, sf_dir).select(F.col("frame_idx").alias("frame_id"), F.col("track_id").alias("point_id"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"))
    paths = tracks.trajectories(p)
    times = paths.select("id", F.explode(F.array(*[F.lit(s / 2) for s in range(6)])).alias("seconds"))
    return tracks.playback_position(paths, times).select("id", "seconds", "frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""{T}, k AS (SELECT frame_idx AS cloud_id, event_id AS idx, CAST(floor((0.25e0 * x + 0.5e0 * y + 2e0 * z - 3e0) * 1000) AS BIGINT) AS depth_key FROM tracking)
 SELECT cloud_id, idx, depth_key, row_number() OVER (PARTITION BY cloud_id ORDER BY depth_key DESC, idx DESC) AS draw_rank,
 round(CASE WHEN max(depth_key) OVER c > min(depth_key) OVER c THEN (depth_key - min(depth_key) OVER c) / CAST(max(depth_key) OVER c - min(depth_key) OVER c AS DOUBLE) ELSE 0e0 END, 6) AS depth_share FROM k WINDOW c AS (PARTITION BY cloud_id)""")
def depth_sort(spark, sf_dir):
    p = tracking(spark, sf_dir).select(F.col("frame_idx").alias("cloud_id"), F.col("event_id").alias("idx"), "x", "y", "z")
    return projection.depth_sort(p, (0.25, 0.5, 2.0, -3.0)).select("cloud_id", "idx", "depth_key", F.col("draw_rank").cast("long").alias("draw_rank"), F.round("depth_share", 6).alias("depth_share"))


def cache_entries(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("cache_id"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"), F.col("n_chars").alias("bytes"), (F.col("doc_id") * 7919 % 10007).alias("last_used"))


@query("""WITH e AS (SELECT source AS cache_id, md5(CAST(doc_id AS VARCHAR)) AS key, n_chars AS bytes, doc_id * 7919 % 10007 AS last_used FROM documents)
 SELECT cache_id, key, bytes FROM (SELECT *, bytes > 30000 AS big, sum(bytes) OVER (PARTITION BY cache_id, bytes > 30000 ORDER BY last_used DESC, key DESC ROWS UNBOUNDED PRECEDING) AS running FROM e)
 WHERE big OR running > 30000""")
def lru_evict(spark, sf_dir):
    return stats.lru_evict(cache_entries(spark, sf_dir), 30_000).select("cache_id", "key", "bytes")


_CACHE_LOG = """WITH log AS (SELECT 'k' || (user_id % 97) AS key, CASE WHEN event_id % 11 = 4 THEN 'evict' WHEN event_id % 3 = 1 THEN 'touch' ELSE 'put' END AS op, CAST(value * 100 AS BIGINT) AS bytes, epoch_us(ts) AS t,
  'w' || (event_id % 2) AS writer, event_id AS seq, 'd' || event_id AS data FROM events), last AS (SELECT key, op, bytes, data FROM log WHERE op <> 'touch' QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC, writer DESC, seq DESC) = 1),
 state AS (SELECT key, md5(key) AS name, bytes, (SELECT max(t) FROM log u WHERE u.key = last.key AND u.op <> 'evict') AS last_used, data FROM last WHERE op = 'put')"""


def cache_log(spark, sf_dir):
    """Events as the records of two sessions that share a cache."""
    e = _t(spark, sf_dir, "events")
    op = F.when(F.expr("event_id % 11 = 4"), "evict").when(F.expr("event_id % 3 = 1"), "touch").otherwise("put")
    columns = {"key": F.concat(F.lit("k"), (F.col("user_id") % 97).cast("string")), "op": op, "bytes": F.round(F.col("value") * 100).cast("long"), "at": F.unix_micros(F.col("ts").cast("timestamp"))}
    columns |= {"writer": F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")), "seq": F.col("event_id"), "data": F.concat(F.lit("d"), F.col("event_id").cast("string"))}
    return e.select(*[c.alias(n) for n, c in columns.items()])


def shared_cache(spark, sf_dir):
    """The log as both sessions write it, in parts that come in any order, with compactions in between."""
    records, path = cache_log(spark, sf_dir), work_dir(spark)
    sessions = [cache.CacheLog(spark, path, remembered=1 << 62) for _ in range(2)]  # the events are years old
    for part in (3, 0, 4, 1, 2):
        for w, log in enumerate(sessions):
            log.append(records.where((F.col("writer") == f"w{w}") & (F.pmod(F.xxhash64("seq"), F.lit(5)) == part)))
        if part in (4, 1):
            sessions[part % 2].compact()
    return sessions[0].state()


@query(f"{_CACHE_LOG} SELECT key, name, bytes, last_used, data FROM state")
def cache_log_state(spark, sf_dir):
    return shared_cache(spark, sf_dir)


@query(f"""{_CACHE_LOG} SELECT key, bytes FROM (SELECT *, bytes > 50000 AS big, sum(bytes) OVER (PARTITION BY bytes > 50000 ORDER BY last_used DESC, key DESC ROWS UNBOUNDED PRECEDING) AS running FROM state) WHERE big OR running > 50000""")
def cache_log_evict(spark, sf_dir):
    """What the shared cache must evict."""
    state = shared_cache(spark, sf_dir).select(F.lit(0).alias("cache_id"), "key", "bytes", "last_used")
    return stats.lru_evict(state, 50_000).select("key", "bytes")


@query("SELECT count(*) AS entries, round(sum(n_chars) / 1048576e0, 6) AS mb, round(100e0 * sum(n_chars) / 10737418240e0, 6) AS usage_percent FROM documents")
def cache_stats(spark, sf_dir):
    return stats.cache_stats(cache_entries(spark, sf_dir)).select("entries", F.round("mb", 6).alias("mb"), F.round("usage_percent", 6).alias("usage_percent"))


def runs(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("series"), r.alias("run_idx"), (F.col("value") + 1).alias("latency_ms"))


_RUNS = "WITH r AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS run_idx, value + 1 AS latency_ms FROM events)"


@query(f"""{_RUNS} SELECT series, count(*) AS runs, round(avg(latency_ms), 3) AS mean_ms, round(stddev_samp(latency_ms), 3) AS std_ms, round(min(latency_ms), 3) AS min_ms, round(max(latency_ms), 3) AS max_ms,
 avg(latency_ms) < 150 AS within_threshold FROM r WHERE run_idx >= 2 GROUP BY series""")
def latency_stats(spark, sf_dir):
    s = stats.latency_stats(runs(spark, sf_dir), ["series"])
    return s.select("series", "runs", *[F.round(c, 3).alias(c) for c in ("mean_ms", "std_ms", "min_ms", "max_ms")], "within_threshold")


@query(f"{_RUNS} SELECT coalesce(series, 'total') AS stage, round(sum(latency_ms), 2) AS ms FROM r GROUP BY ROLLUP (series)")
def stage_breakdown(spark, sf_dir):
    r = runs(spark, sf_dir).select(F.col("series").alias("stage"), F.col("latency_ms").alias("ms"))
    return stats.stage_breakdown(r).withColumn("ms", F.round("ms", 2))


_LOG = "WITH l AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clip, value * 4 AS ram_mb FROM events)"


def endurance_log(spark, sf_dir):
    return tracking(spark, sf_dir).select(F.col("track_id").alias("series"), (F.col("frame_idx") + 1).alias("clip"), (F.col("y") * 4).alias("ram_mb"))


@query(f"""{_LOG}, d AS (SELECT *, ram_mb - first_value(ram_mb) OVER (PARTITION BY series ORDER BY clip) AS delta FROM l)
 SELECT series, clip, round(delta, 4) AS delta_mb, CASE WHEN delta > 150 THEN 'FAIL' WHEN delta > 75 THEN 'WARN' ELSE 'OK' END AS status FROM d""")
def endurance_status(spark, sf_dir):
    return stats.endurance_rows(endurance_log(spark, sf_dir)).select("series", "clip", F.round("delta_mb", 4).alias("delta_mb"), "status")


@query(f"""{_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY clip DESC) AS back, count(*) OVER (PARTITION BY series) AS n FROM l),
 g AS (SELECT series, max(n) AS clips, max(ram_mb) FILTER (WHERE back = 1) - max(ram_mb) FILTER (WHERE clip = 1) AS growth, avg(ram_mb) FILTER (WHERE back <= 10) - avg(ram_mb) FILTER (WHERE clip <= 10) AS t FROM n GROUP BY series),
 v AS (SELECT series, clips, growth, CASE WHEN clips >= 20 THEN t ELSE growth END AS trend FROM g)
 SELECT series, clips, round(growth, 4) AS growth_mb, round(trend, 4) AS trend_mb, growth > 150 AND trend > 30 AS failed FROM v""")
def endurance_trend(spark, sf_dir):
    return stats.endurance_verdict(endurance_log(spark, sf_dir)).select("series", "clips", F.round("growth_mb", 4).alias("growth_mb"), F.round("trend_mb", 4).alias("trend_mb"), "failed")


@query("""SELECT doc_id, trim(text, ' ') AS text, CAST(n_chars % 101 AS INT) AS conf FROM documents WHERE n_chars % 101 >= 40 AND trim(text, ' ') <> ''""")
def ocr_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", (F.col("n_chars") % 101).cast("int").alias("conf"))
    return projection.ocr_filter(d)


@query(f"{T} SELECT event_id, frame_idx FROM tracking WHERE frame_idx % 5 = 0")
def frame_skip(spark, sf_dir):
    return projection.sample_frames(tracking(spark, sf_dir), 5).select("event_id", "frame_idx")


@query("SELECT page_id, concat_ws(' | ', 'pages', url, sha256(html)) AS line, md5(url) AS cache_key FROM pages")
def hash_manifest(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.concat_ws(" | ", F.lit("pages"), "url", F.sha2("html", 256)).alias("line"), F.md5("url").alias("cache_key"))


@query("""WITH v AS (SELECT i, var_samp(x) AS v FROM (SELECT generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY i),
 r AS (SELECT i, v / (SELECT sum(v) FROM v) AS ratio FROM v) SELECT CAST(k AS INT) AS k, round(sum(ratio), 6) AS cumulative FROM (SELECT unnest([10, 20, 32, 48, 64]) AS k), r WHERE i <= k GROUP BY k""")
def cumulative_variance(spark, sf_dir):
    """Of the vectors' own components."""
    v = _t(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy((F.col("i") + 1).alias("k")).agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    total = v.agg(F.sum("v").alias("total"))  # one row
    ratios = v.join(F.broadcast(total)).select("k", (F.col("v") / F.col("total")).alias("ratio"))
    return E.cumulative_variance(ratios, (10, 20, 32, 48, 64)).withColumn("cumulative", F.round("cumulative", 6))


@query("SELECT source AS name, round(100 * (1 - sum(length(text)) / CAST(sum(4 * length(text)) AS DOUBLE)), 6) AS reduction_percent FROM documents GROUP BY source")
def size_reduction(spark, sf_dir):
    s = _t(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.sum(4 * F.length("text")).alias("bytes_before"), F.sum(F.length("text")).alias("bytes_after"))
    return stats.size_reduction(s).select("name", F.round("reduction_percent", 6).alias("reduction_percent"))


@query("SELECT date_trunc('second', ts)::TIMESTAMP AS second, count(*) AS frames, count(DISTINCT user_id) AS active_tracks FROM events GROUP BY 1")
def frames_per_second(spark, sf_dir):
    return stats.frames_per_second(_t(spark, sf_dir, "events").withColumnRenamed("user_id", "track_id")).withColumn("second", F.col("second").cast("timestamp_ntz"))


@query(f"""{T} SELECT frame_idx, CASE WHEN frame_idx % 3 = 0 THEN 'cached' ELSE 'computed' END AS origin, count(*) AS tracks FROM tracking GROUP BY frame_idx""")
def cache_read_through(spark, sf_dir):
    n = tracking(spark, sf_dir).groupBy("frame_idx").agg(F.count("*").alias("tracks"))
    mark = lambda d, o: d.withColumn("origin", F.lit(o)).select("frame_idx", "origin", "tracks")
    return read_through(mark(n.where("frame_idx % 3 = 0"), "cached"), n, lambda d: mark(d, "computed"))


_WINDOW_COUNTS = f"""{T}, w AS (SELECT track_id AS clip_id, unnest(range(greatest(0, CAST(floor((frame_idx - 16) / 12e0) AS BIGINT) + 1), CAST(floor(frame_idx / 12e0) AS BIGINT) + 1)) AS window_id, y FROM tracking)
 SELECT clip_id, window_id, count(*) AS frames, round(sum(y), 4) AS total FROM w GROUP BY ALL"""


@query(_WINDOW_COUNTS)
def window_counts(spark, sf_dir):
    f = tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx", F.col("y").alias("value"))
    return streams.window_counts(f).withColumn("total", F.round("total", 4))


# Models, files, streams.


@query()
def pca_reduce(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select(F.lit(0).alias("clip_id"), F.col("label").alias("track_id"), F.col("vec_id").alias("frame_idx"), "embedding")
    return chains.prepare_embeddings(e, k=16)[0]


@query("""WITH b AS (SELECT page_id, regexp_extract_all(hex(encode(html)), '..') AS h FROM pages)
 SELECT page_id AS frame_idx, round(coalesce(list_avg([CAST('0x' || x AS INT) FOR x IN h]), 0e0) / 255 + 1, 9) AS depth FROM b""")
def model_udf(spark, sf_dir):
    f = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("frame_idx"), F.col("html").cast("binary").alias("content"))
    return apply_model(f, StubDepth(), "frame_idx long, depth double").withColumn("depth", F.round("depth", 9))


@query(f"""{T}, f AS (SELECT track_id AS clip_id, frame_idx, frame_idx - min(frame_idx) OVER (PARTITION BY track_id) AS t FROM tracking)
 SELECT clip_id, frame_idx, iy * 2 + ix AS track_id, CAST(CAST(112e0 * (ix + 0.5e0) AS FLOAT) + CAST(t AS FLOAT) * 2.5 AS DOUBLE) AS x, CAST(CAST(112e0 * (iy + 0.5e0) AS FLOAT) + CAST(t AS FLOAT) * 2.5 AS DOUBLE) AS y, true AS visible
 FROM f, range(2) a(iy), range(2) b(ix)""")
def tracker_udf(spark, sf_dir):
    f = tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx")
    return apply_per_clip(f, StubTracker(grid_size=2), "clip_id long, frame_idx long, track_id long, x double, y double, visible boolean")


@query()
def clip_fusion_graph(spark, sf_dir):
    t = gen.random_tracks(spark, 4, 100)
    d = gen.random_depth(spark, 4, 224, 224)
    f = gen.random_vectors(spark, 2 * 196, 64).select(F.lit(0).alias("clip_id"), F.expr("cast(id div 196 as int)").alias("slot"), F.expr("cast(id % 196 as int)").alias("patch_idx"), "embedding")
    return chains.fusion_graph_of_clip(t, d, f, 2, 224, 224)[1]


@query()
def random_sources(spark, sf_dir):
    return gen.random_clip(spark, 2, 3, 16).select("frame_idx", "channel", F.size("pixels").alias("n"))


@query(_WINDOW_COUNTS)
def stream_frame_windows(spark, sf_dir):
    """The windows of a stream of frames, run to its end: each micro-batch's whole result replaces the table before it."""
    work = work_dir(spark)
    f = tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx", F.col("y").alias("value"))
    f.write.mode("overwrite").parquet(f"{work}/in")
    counts = streams.window_counts(streams.read_frames(spark, f"{work}/in", f.schema))

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/epoch={epoch}")

    q = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    last = out.agg(F.max("epoch")).first()[0]
    return out.where(F.col("epoch") == last).drop("epoch").withColumn("total", F.round("total", 4))


@query("SELECT vec_id AS track_id, label || ' track_' || vec_id AS page_content, CAST(label AS VARCHAR) AS class_name FROM embeddings")
def stream_append_index(spark, sf_dir):
    """Identities that arrive in a stream, indexed batch by batch."""
    work = work_dir(spark)
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding", F.create_map(F.lit("class_name"), F.col("label").cast("string")).alias("metadata"))
    e.write.mode("overwrite").parquet(f"{work}/in")
    streams.grow_index(streams.read_frames(spark, f"{work}/in", e.schema), search.index_identities, f"{work}/index", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/index").select("track_id", "page_content", "class_name")


# Tables written and read again.


@query("SELECT vec_id AS track_id, 'c' || label || ' track_' || vec_id AS page_content, len(embedding) AS dim FROM embeddings")
def index_grow(spark, sf_dir):
    """An index that is saved, loaded, grown and saved again, and then read by another one."""
    ids = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding", F.create_map(F.lit("class_name"), F.concat(F.lit("c"), F.col("label").cast("string"))).alias("metadata"))
    path = work_dir(spark)
    first = search.VectorIndex(spark, path)
    first.index_embeddings(ids.where("track_id % 3 = 0"))
    first.save()
    for part in (1, 2):
        more = search.VectorIndex(spark, path)
        more.load()
        more.add_embedding(ids.where(f"track_id % 3 = {part}"))
        more.save()
    last = search.VectorIndex(spark, path)
    last.load()
    return last.rows.select("track_id", "page_content", F.size("embedding").cast("long").alias("dim"))


@query("""WITH a AS (SELECT vec_id AS track_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 d AS (SELECT b.track_id AS query_id, a.track_id, sqrt(sum(pow(a.v - b.v, 2))) AS distance FROM a JOIN a b ON a.i = b.i AND b.track_id IN (7, 100, 333) GROUP BY 1, 2)
 SELECT query_id, track_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, track_id) AS n FROM d) WHERE n <= 8""")
def knn_of_several(spark, sf_dir):
    """The search for three vectors at once."""
    index = _index(spark, sf_dir)
    hits = knn.knn_join(index.where("track_id in (7, 100, 333)").withColumnRenamed("track_id", "query_id"), index, 8)
    return hits.select("query_id", "track_id", F.round("distance", 6).alias("distance"))


_MANY = """WITH a AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
 d AS (SELECT b.vec_id AS query_id, a.vec_id AS track_id, sqrt(sum(pow(a.v - b.v, 2))) AS distance FROM a JOIN a b ON a.i = b.i AND b.vec_id % 100 = 0 {where} GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, track_id) AS rank FROM d) SELECT query_id, track_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM r WHERE rank <= 10"""


def _many(spark, sf_dir, where=None):
    index = _index(spark, sf_dir)
    hits = knn.knn_join(index.where("track_id % 100 = 0").withColumnRenamed("track_id", "query_id"), index, 10, where=where)
    return hits.select("query_id", "track_id", "rank", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query(_MANY.format(where=""))
def knn_many(spark, sf_dir):
    """The search for every vector whose id is divisible by 100, against all, as one join."""
    return _many(spark, sf_dir)


@query(_MANY.format(where="WHERE a.label = 3"))
def knn_many_filtered(spark, sf_dir):
    return _many(spark, sf_dir, {"class_name": "3"})


_ANNOTATED = f"""{T}, d AS (SELECT frame_idx, 'e' || event_id AS text, CAST(event_id % 90 AS INT) AS bx, CAST(event_id % 71 AS INT) AS b_y, CAST(event_id % 19 AS INT) AS bw, CAST(event_id % 13 AS INT) AS bh, CAST(event_id % 101 AS DOUBLE) AS confidence FROM tracking WHERE frame_idx % 2 = 0),
 c AS (SELECT *, bx + bw / 2e0 AS cx, b_y + bh / 2e0 AS cy FROM d WHERE confidence >= 50 AND frame_idx % 3 <> 1),
 p AS (SELECT *, CAST(greatest(0, least(round_even(cx, 0), {W - 1})) AS BIGINT) AS u, CAST(greatest(0, least(round_even(cy, 0), {H - 1})) AS BIGINT) AS v FROM c),
 z AS (SELECT *, CAST(CAST({_DEPTH} AS FLOAT) AS DOUBLE) * 0.5 AS z FROM p)
 SELECT frame_idx, text, round((cx - 64) * z / 128, 4) + 0e0 AS x, round((cy - 48) * z / 128, 4) + 0e0 AS y, round(z, 4) AS z, confidence, u, v FROM z WHERE z > 0"""


def _seen_frames(spark, sf_dir):
    """Frames whose content stands for what is seen in them, and the depth maps of most of them."""
    box = F.struct(*[(F.col("event_id") % m).cast("int").alias(c) for c, m in (("x", 90), ("y", 71), ("w", 19), ("h", 13))])
    seen = F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("text"), box.alias("bbox"), (F.col("event_id") % 101).cast("int").alias("conf"))
    frames = tracking(spark, sf_dir).groupBy("frame_idx").agg(F.to_json(F.collect_list(seen)).cast("binary").alias("content"))
    return frames, depth_maps(spark, frames.where("frame_idx % 3 <> 1"))


def _detector(content):
    import json

    return json.loads(bytes(content))


def _annotation_columns(a):
    return a.select("frame_idx", "text", *[F.round(f"position_3d.{c}", 4).alias(c) for c in "xyz"], "confidence", F.col("pixel_uv.u").cast("long").alias("u"), F.col("pixel_uv.v").cast("long").alias("v"))


@query(_ANNOTATED)
def frame_annotations(spark, sf_dir):
    """Frames through a detector and their depth maps to 3-D annotations."""
    frames, depth = _seen_frames(spark, sf_dir)
    return _annotation_columns(chains.annotate_frames(frames, depth, _detector, K, H, W, min_confidence=50.0, depth_scale=0.5, frame_skip=2))


def _frame_time():
    """A frame a second."""
    return F.timestamp_seconds(F.col("frame_idx") + 1_700_000_000)


#: Where streams of frames are cut into what arrives at once.
_CUTS = ("frame_idx < 20", "frame_idx >= 20 and frame_idx < 45", "frame_idx >= 45")


@query(_ANNOTATED)
def stream_frame_annotations(spark, sf_dir):
    """The same from two streams; each part of the maps arrives a micro-batch after its frames."""
    work = work_dir(spark)
    frames, depth = (settle(d.withColumn("ts", _frame_time())) for d in _seen_frames(spark, sf_dir))
    depth.limit(0).write.parquet(f"{work}/depth")
    for i in range(len(_CUTS) + 1):
        if i < len(_CUTS):
            frames.where(_CUTS[i]).write.mode("append").parquet(f"{work}/frames")
        if i:
            depth.where(_CUTS[i - 1]).write.mode("append").parquet(f"{work}/depth")
        a, b = (streams.read_frames(spark, f"{work}/{n}", d.schema) for n, d in (("frames", frames), ("depth", depth)))
        met = fusion.annotate_streams(a, b, _detector, K, H, W, min_confidence=50.0, depth_scale=0.5, frame_skip=2)
        fusion.to_epochs(met, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _annotation_columns(spark.read.parquet(f"{work}/out"))


def _follow(part, points):
    """A tracker that moves its start points, or those of a 2 x 2 grid, by 2.5 a frame, and tells where its window starts."""
    import numpy as np
    import pandas as pd

    if not len(part):
        return pd.DataFrame(columns=["clip_id", "frame_idx", "track_id", "x", "since"])
    f = part["frame_idx"].to_numpy()
    ids, x = (np.arange(4), 112 * (np.arange(4) % 2 + 0.5)) if points is None else (points["track_id"].to_numpy(), points["x"].to_numpy())
    n = len(f) * len(ids)
    return pd.DataFrame({"clip_id": np.full(n, part["clip_id"].iloc[0]), "frame_idx": np.repeat(f, len(ids)), "track_id": np.tile(ids, len(f)), "x": (x + 2.5 * (f - f[0])[:, None]).ravel(), "since": np.full(n, f[0])})


_FOLLOWED = f"""{T}, n AS (SELECT track_id AS clip_id, count(*) AS n FROM tracking GROUP BY track_id)
 SELECT clip_id, frame_idx, i AS track_id, 112e0 * (i % 2 + 0.5e0) + 2.5e0 * frame_idx AS x, 12 * least(frame_idx // 12, CAST(ceil((n - 4) / 12e0) AS BIGINT) - 1) AS since FROM n JOIN tracking t ON t.track_id = n.clip_id, range(4) r(i) WHERE n > 4"""
_FOLLOWS = "clip_id long, frame_idx long, track_id long, x double, since long"


@query(_FOLLOWED)
def stitched_clips(spark, sf_dir):
    """Clips through a tracker window by window; its start points and its window tell that each began where the last one left."""
    return windows.stitch_clip(tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx"), _follow, _FOLLOWS)


@query(_FOLLOWED)
def stream_stitched(spark, sf_dir):
    """The same from a stream that is cut within windows; a last row of another clip, much later, lets the timers close all clips."""
    work = work_dir(spark)
    ts = _frame_time().alias("ts")
    frames = settle(tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx", ts))
    later = frames.agg((F.max("frame_idx") + 100_000).alias("frame_idx")).select(F.lit(-1).cast("long").alias("clip_id"), "frame_idx", ts)
    for part in [*map(frames.where, _CUTS), later]:
        part.write.mode("append").parquet(f"{work}/in")
        with stitching.rocksdb_state(spark):
            found = stitching.stitch_stream(streams.read_frames(spark, f"{work}/in", frames.schema), _follow, _FOLLOWS)
            q = fusion.to_epochs(found, f"{work}/out", f"{work}/checkpoint")
        q.awaitTermination()
    return spark.read.parquet(f"{work}/out").drop("epoch")


@query(f"""{T} SELECT track_id, count(*) AS n, sum(frame_idx)::BIGINT AS frames, round(sum(CAST(CAST(x AS FLOAT) AS DOUBLE)), 3) AS x, round(sum(CAST(CAST(z AS FLOAT) AS DOUBLE)), 3) AS z, min(class_name) AS ocr_text FROM tracking GROUP BY track_id""")
def tracking_round_trip(spark, sf_dir):
    """Two batches through the writer, read back through the store."""
    t, path = tracking(spark, sf_dir).withColumnRenamed("class_name", "ocr_text"), work_dir(spark)
    with TrackWriter(spark, path) as w:
        for part in (0, 1):
            w.write(t.where(f"event_id % 2 = {part}"))
    each = lambda c: F.round(F.sum(F.col(c).cast("double")), 3).alias(c)
    return TrackStore(spark, path).df.groupBy("track_id").agg(F.count("*").alias("n"), F.sum("frame_idx").alias("frames"), each("x"), each("z"), F.min("ocr_text").alias("ocr_text"))


@query(f"""{_PROJECT} SELECT frame_idx AS frame_id, count(*) AS points, count(*) FILTER (z > 0) AS valid_points, round(sum(CAST(z AS DOUBLE)), 3) AS z FROM d GROUP BY frame_idx""")
def point_cloud_round_trip(spark, sf_dir):
    """Projected points as CSV with a header, read back."""
    path = work_dir(spark)
    t = tracking(spark, sf_dir).withColumns({"x": F.col("x").cast("float"), "y": F.col("y").cast("float")})
    write_point_cloud(projection.project_to_3d(t, depth_maps(spark, t), H, W), path)
    return read_point_cloud(spark, path).groupBy("frame_id").agg(F.count("*").alias("points"), F.count_if("valid").alias("valid_points"), F.round(F.sum(F.col("Z").cast("double")), 3).alias("z"))


@query(f"""{T} SELECT track_id AS id, CAST(25 AS INT) AS fps, count(*) AS steps, sum(frame_idx)::BIGINT AS frames, round(sum(x), 3) AS x, true AS coloured FROM tracking GROUP BY track_id""")
def trajectory_round_trip(spark, sf_dir):
    """Paths as lines of JSON, read back; a track has one colour, within [0, 1)."""
    path = work_dir(spark)
    p = tracking(spark, sf_dir).select(F.col("frame_idx").alias("frame_id"), F.col("track_id").alias("point_id"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"))
    write_trajectory_parts(p, path, 25)
    step = read_trajectory_parts(spark, path).select("fps", "id", F.inline("path"))
    colour = F.expr("count(distinct r, g, b) = 1 and min(least(r, g, b)) >= 0 and max(greatest(r, g, b)) < 1 and count(distinct r) = 1")
    return step.groupBy("id", "fps").agg(F.count("*").alias("steps"), F.sum("f").alias("frames"), F.round(F.sum("x"), 3).alias("x"), colour.alias("coloured"))


@query("SELECT 'pages | ' || url || ' | ' || sha256(html) AS line FROM pages")
def manifest_round_trip(spark, sf_dir):
    path = work_dir(spark)
    write_manifest(_t(spark, sf_dir, "pages").select(F.col("url").alias("file"), F.sha2("html", 256).alias("digest")), "pages", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""{T}, t AS (SELECT track_id, frame_idx, least(frame_idx, (SELECT count(*) FROM embeddings) // 196 - 1) AS slot, CAST(greatest(0, least(round_even(CAST(x AS FLOAT), 0), {W - 1})) AS BIGINT) AS u, CAST(greatest(0, least(round_even(CAST(y AS FLOAT), 0), {H - 1})) AS BIGINT) AS v,
  CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y FROM tracking),
 p AS (SELECT *, CAST(CAST({_DEPTH} AS FLOAT) AS DOUBLE) AS z, CAST(floor(greatest(0, least(y, 223)) / 16) * 14 + floor(greatest(0, least(x, 223)) / 16) AS INT) AS patch FROM t)
 SELECT p.frame_idx AS graph_id, p.track_id AS node_idx, e.vec_id IS NOT NULL AS has_embedding, 3 + 64 AS width, round((x - 64) * z / 128, 3) + 0e0 AS px, round(z, 3) AS pz
 FROM p LEFT JOIN embeddings e ON e.vec_id = slot * 196 + patch WHERE z > 0""")
def fusion_graph_nodes(spark, sf_dir):
    """Tracks, depth maps and patch embeddings to the nodes of the frames' fusion graphs; invalid depths are dropped."""
    t = tracking(spark, sf_dir).select(F.lit(0).alias("clip_id"), "frame_idx", "track_id", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"))
    e = _t(spark, sf_dir, "embeddings")
    f = e.select(F.lit(0).alias("clip_id"), F.expr("cast(vec_id div 196 as int)").alias("slot"), F.expr("cast(vec_id % 196 as int)").alias("patch_idx"), "embedding")
    n = chains.fusion_graph_of_clip(t, depth_maps(spark, t), f, e.count() // 196, H, W, drop_invalid=True)[0]
    return n.select("graph_id", "node_idx", "has_embedding", F.size("features").alias("width"), F.round(F.col("px").cast("double"), 3).alias("px"), F.round(F.col("pz").cast("double"), 3).alias("pz"))


@query(f"""{T}, f AS (SELECT track_id AS clip_id, frame_idx, frame_idx - min(frame_idx) OVER (PARTITION BY track_id) AS t FROM tracking),
 p AS (SELECT clip_id, frame_idx, iy * 2 + ix AS track_id, 112e0 * (ix + 0.5e0) + t * 2.5e0 AS x, 112e0 * (iy + 0.5e0) + t * 2.5e0 AS y FROM f, range(2) a(iy), range(2) b(ix)),
 k AS (SELECT *, least(frame_idx, 1) * 196 + floor(least(y, 223) / 16) * 14 + floor(least(x, 223) / 16) AS token FROM p)
 SELECT clip_id, frame_idx, track_id, round(list_sum([CAST((CAST(token AS BIGINT) * 31 + j * 7 + clip_id) % 97 AS DOUBLE) / 97 FOR j IN range(8)]), 4) AS total FROM k""")
def semantic_tracks(spark, sf_dir):
    """Clips tracked, embedded and mapped to each other, with stand-in models."""
    f = tracking(spark, sf_dir).select(F.col("track_id").alias("clip_id"), "frame_idx")
    s = chains.extract_semantics(f, StubTracker(grid_size=2), StubEmbedder(slots=2, dim=8), 2)
    return s.select("clip_id", "frame_idx", "track_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), m AS (SELECT i, avg(e) AS m FROM e GROUP BY i),
 l AS (SELECT label, i, avg(e) AS a FROM e GROUP BY label, i) SELECT label AS track_id, 64 AS dim, round(sum(pow(a - m, 2)), 6) AS squared_norm FROM l JOIN m USING (i) GROUP BY label""")
def pca_rotation(spark, sf_dir):
    """Identities after a PCA that keeps all dimensions, saved and loaded: a rotation about the mean, so norms are known."""
    e = _t(spark, sf_dir, "embeddings").select(F.lit(0).alias("clip_id"), F.col("label").alias("track_id"), F.col("vec_id").alias("frame_idx"), "embedding")
    path = work_dir(spark)
    E.save_pca(E.fit_pca(e, 64), path)
    out, _ = chains.prepare_embeddings(e, E.load_pca(spark, path), normalize=False)
    return out.select("track_id", F.size("embedding").alias("dim"), F.round(V.dot("embedding", "embedding"), 6).alias("squared_norm"))


#: The covariance of all vectors; sums of powers of its eigenvalues are traces of its powers.
_COVARIANCE = """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), d AS (SELECT vec_id, i, x - m AS x FROM e JOIN m USING (i)),
 c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) - 1 FROM embeddings) AS c FROM d a JOIN d b USING (vec_id) GROUP BY 1, 2)"""


@query(f"{_COVARIANCE} SELECT 64 AS components, round(sum(c) FILTER (i = j), 6) AS variance, round(sum(c * c), 8) AS squares, true AS falling FROM c")
def pca_spectrum(spark, sf_dir):
    """Variances of all components of the reduced vectors: their squares add up to those of the covariance only if the PCA has turned it diagonal."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = E.transform_pca(E.fit_pca(e, 64), e).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    s = v.agg(F.count("*").cast("int").alias("components"), F.round(F.sum("v"), 6).alias("variance"), F.round(F.sum(F.col("v") * F.col("v")), 8).alias("squares"), values.alias("vs"))
    return s.select("components", "variance", "squares", F.forall(F.sequence(F.lit(1), F.size("vs") - 1), lambda i: F.get("vs", i) <= F.get("vs", i - 1) + 1e-12).alias("falling"))


@query(f"""{_COVARIANCE}, c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
 SELECT (SELECT count(*) FROM embeddings) AS n, round(sum(c.c) FILTER (c.i = c.j), 6) AS variance, round(sum(c.c * c.c), 8) AS squares, round(sum(c.c * c2.c), 9) AS cubes, 1e0 AS share FROM c JOIN c2 USING (i, j)""")
def stream_pca(spark, sf_dir):
    """Explained variances of a PCA that grows with a stream, from summaries of bounded size."""
    work, pca = work_dir(spark), IncrementalPCA(64, 64)
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    for part in range(3):
        e.where(f"vec_id % 3 = {part}").write.mode("append").parquet(f"{work}/in")
        q = streams.read_frames(spark, f"{work}/in", e.schema).writeStream.foreachBatch(lambda batch, _: pca.update(batch) and None)
        q.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    _, variances, shares = pca.components(64)
    sums = [float((variances**p).sum()) for p in (1, 2, 3)]
    return spark.createDataFrame([(pca.known.n, round(sums[0], 6), round(sums[1], 8), round(sums[2], 9), round(float(shares.sum()), 9))], "n long, variance double, squares double, cubes double, share double")


@query("SELECT event_id, event_id // 7 % 3 = 1 AS failed_first FROM events")
def stream_guarded(spark, sf_dir):
    """A stream of which some micro-batches fail: their rows are kept, processed again later, and none is lost."""
    work = work_dir(spark)
    e = _t(spark, sf_dir, "events").select("event_id")
    for part in range(3):
        e.where(f"event_id div 7 % 3 = {part}").coalesce(1).write.mode("append").parquet(f"{work}/in")

    def process(batch: DataFrame, epoch: int) -> None:
        bad = F.when(F.expr("event_id div 7 % 3 = 1"), F.raise_error(F.lit("can't be processed")).cast("long")).otherwise(F.col("event_id"))
        batch.select(bad.alias("event_id")).write.mode("overwrite").parquet(f"{work}/out/epoch={epoch}")

    q, _ = streams.run_guarded(streams.read_frames(spark, f"{work}/in", e.schema, 1), process, f"{work}/checkpoint", dead_letters=f"{work}/failed")
    q.awaitTermination()
    done, again = (spark.read.schema("event_id long").parquet(f"{work}/{n}/epoch=*") for n in ("out", "failed"))
    return done.withColumn("failed_first", F.lit(False)).unionByName(again.withColumn("failed_first", F.lit(True)))
