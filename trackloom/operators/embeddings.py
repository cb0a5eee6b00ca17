"""Aggregations over embeddings: identity means, diagnostics, validation, PCA."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULTS


def identity_parts(rows: DataFrame, key: str = "track_id", weight: str | None = None) -> DataFrame:
    """Element-wise mean by key in long form (key, pos, value): each row is added up map-side.

    With a weight: the weighted mean, the plain one where weights sum to zero; a negative weight fails the query.
    """
    w = F.lit(1.0) if weight is None else F.when(F.col(weight) < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col(weight).cast("double"))
    x = rows.select(key, w.alias("w"), F.posexplode("embedding").alias("pos", "e")).withColumn("e", F.col("e").cast("double"))
    mean = F.avg("e") if weight is None else F.when(F.sum("w") == 0, F.avg("e")).otherwise(F.sum(F.col("w") * F.col("e")) / F.sum("w"))
    return x.groupBy(key, "pos").agg(mean.alias("value"))


def identity_embedding(rows: DataFrame, key: str = "track_id", weight: str | None = None) -> DataFrame:
    """(key, embedding): the mean vector of each key."""
    parts = identity_parts(rows, key, weight)
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("embedding"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row: least, largest, mean, population deviation, bytes, NaNs and infinities of all components."""
    e = rows.select(F.explode("embedding").alias("e"))
    d = F.col("e").cast("double")
    ok = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
    return e.agg(
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"),
        (F.count("*") * 4).alias("bytes"), F.count_if(F.isnan(d)).alias("nan_count"), F.count_if(F.abs(d) == float("inf")).alias("inf_count"),
    )


def validation(rows: DataFrame, n_rows: int, dim: int) -> DataFrame:
    """One row: which checks hold, and whether all do."""
    bad = lambda f: F.exists("embedding", f)
    checks = rows.agg(
        (F.count("*") == n_rows).alias("count_ok"),
        F.coalesce(F.bool_and(F.size("embedding") == dim), F.lit(True)).alias("dim_ok"),
        F.coalesce(F.bool_and(~bad(lambda x: F.isnan(x))), F.lit(True)).alias("no_nan"),
        F.coalesce(F.bool_and(~bad(lambda x: F.abs(x) == float("inf"))), F.lit(True)).alias("no_inf"),
    )
    return checks.withColumn("ok", F.expr("count_ok and dim_ok and no_nan and no_inf"))


def require_valid(rows: DataFrame, n_rows: int, dim: int) -> DataFrame:
    """``rows`` if all checks hold, else ValueError."""
    got = validation(rows, n_rows, dim).first()
    if not got["ok"]:
        raise ValueError(f"embeddings are not valid: {[k for k, v in got.asDict().items() if v is False]}")
    return rows


def fit_pca(rows: DataFrame, k: int = DEFAULTS.pca_dim) -> PipelineModel:
    """Exact PCA of mean-centred vectors; needs at least k rows."""
    v = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    if v.limit(k).count() < k:
        raise ValueError(f"PCA to {k} dimensions needs at least {k} vectors")
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False), PCA(k=k, inputCol="centred", outputCol="reduced")]).fit(v)


def transform_pca(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with their embedding reduced."""
    if model is None:
        raise RuntimeError("the PCA is not fitted")
    got = model.transform(rows.withColumn("raw", array_to_vector(F.col("embedding").cast("array<double>"))))
    return got.withColumn("embedding", vector_to_array("reduced")).drop("raw", "centred", "reduced")


def save_pca(model: PipelineModel | None, path: str) -> None:
    """Replaces what is at ``path``; a model that isn't fitted is a RuntimeError."""
    if model is None:
        raise RuntimeError("the PCA is not fitted")
    model.write().overwrite().save(path)


def load_pca(spark: SparkSession, path: str) -> PipelineModel:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def explained_variance(model: PipelineModel, spark, marks: tuple[int, ...] = (10, 20, 32, 48, 64)) -> DataFrame:
    ratios = model.stages[-1].explainedVariance.toArray().tolist()
    return cumulative_variance(spark.createDataFrame(list(enumerate(ratios, 1)), "k int, ratio double"), marks)


def cumulative_variance(ratios: DataFrame, marks: tuple[int, ...]) -> DataFrame:
    """(k, ratio) to the cumulative ratio at the marks; a row for each component."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ratios.withColumn("cumulative", F.sum("ratio").over(w)).where(F.col("k").isin(*marks)).select("k", "cumulative")
