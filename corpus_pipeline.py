"""From raw documents to packed sequences: five of the training-data operators, one after the other.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import mixing, nearcopies, packing, pii, toxicity
from trackloom.llm.common import Scratch, clear_scratch, scratch_mark, table
from trackloom.llm.queries import ranks_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier, fitted on the table's labels, predicts toxic.

    Null and empty texts stay; rows that repeat stay or go together; with no usable label nothing goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id stays (null last). Texts without words, null or not, are copies of each other; of equal rows one stays.
    """
    return nearcopies.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind. All rows stay; null and empty texts stay as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes.

    Null texts and texts without words have no size and leave; a null source is a source; repeated rows are mixed one by one.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its ids and its place in a sequence; null and empty texts give the end id alone."""
    return packing.pack(docs, ranks_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A fitted classifier, hashing and byte-pair encoding are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the table of documents. Extra columns go along to the mix; an empty table gives no rows.

    What a stage has read and made for itself is deleted as soon as its result is written; the last one's result is lazy.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        mark, before = scratch_mark(), docs
        docs = scratch.cut(stage(spark, before, sf_dir))
        clear_scratch(spark, mark)
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
