"""Vector search over identities: an exact scan with metadata filters before the top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schemas import DEFAULTS, INDEX
from ..sources.files import exists, table_path
from ..sources.versions import Versions
from .knn import knn_join


def index_identities(identities: DataFrame, dim: int = DEFAULTS.pca_dim) -> DataFrame:
    """(track_id, embedding, metadata) to index rows: the document text, its vector, and the metadata's class."""
    cls = F.try_element_at("metadata", F.lit("class_name"))
    text = V.document_text(cls, "track_id")
    return identities.select("track_id", text.alias("page_content"), V.text_vector(text, dim).alias("text_vec"), "embedding", cls.alias("class_name"), "metadata")


def nearest(index: DataFrame, query: Column, k: int = DEFAULTS.top_k, where: dict[str, object] | None = None, vector: str = "embedding", id_col: str = "track_id") -> DataFrame:
    """The k rows nearest to a query vector, smaller distance first, ties by id; filters hold before the top-k.

    Filters name columns, or keys of a ``metadata`` map. The plan is a projection and TakeOrderedAndProject.
    """
    for key, value in (where or {}).items():
        index = index.where((F.col(key) if key in index.columns else F.try_element_at("metadata", F.lit(key))) == F.lit(value))
    return index.withColumn("distance", V.l2_distance(vector, query)).orderBy("distance", id_col).limit(k).withColumn("similarity", 1 / (1 + F.col("distance")))


class VectorIndex:
    """A saved or growing index of identities."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: DataFrame | None = None, dim: int = DEFAULTS.pca_dim):
        self.spark, self.path, self.rows, self.dim = spark, path, rows, dim

    def index_embeddings(self, identities: DataFrame) -> None:
        if identities.isEmpty():
            raise ValueError("no identities to index")
        self.rows = index_identities(identities, self.dim)

    def add_embedding(self, identities: DataFrame) -> None:
        new = index_identities(identities, self.dim)
        self.rows = new if self.rows is None else self.rows.unionByName(new)

    def search(self, query: str, k: int = DEFAULTS.top_k, where: dict[str, str] | None = None) -> DataFrame:
        if self.rows is None:
            raise RuntimeError("the index is empty")
        hits = nearest(self.rows, V.text_vector(F.lit(query), self.dim), k, where, "text_vec")
        return hits.select("track_id", "distance", "similarity", F.coalesce("class_name", F.lit("unknown")).alias("class_name"), "metadata")

    def search_many(self, queries: DataFrame, k: int = DEFAULTS.top_k, where: dict[str, str] | None = None) -> DataFrame:
        """The hits of all ``queries`` (query_id, query) at once; the same as those of ``search`` for each of them."""
        if self.rows is None:
            raise RuntimeError("the index is empty")
        asked = queries.select("query_id", V.text_vector("query", self.dim).alias("text_vec"))
        hits = knn_join(asked, self.rows, k, vector="text_vec", where=where, keep=("class_name", "metadata"))
        return hits.select("query_id", "track_id", "distance", "similarity", F.coalesce("class_name", F.lit("unknown")).alias("class_name"), "metadata")

    def save(self) -> None:
        """Commits the rows as the table's next version; they may still be read from the one before."""
        if self.rows is None:
            raise RuntimeError("the index is empty")
        versions = Versions(self.spark, self.path)
        name = versions.begin()
        self.rows.write.parquet(versions.folder(name))
        versions.commit(name)
        self.load()

    def load(self) -> None:
        at = table_path(self.spark, self.path)
        if not exists(self.spark, at):
            raise FileNotFoundError(self.path)
        self.rows = self.spark.read.schema(INDEX).parquet(at)
