"""From documents to training data: five stages, each written as Parquet and read again as the next one's input.

quality (documents that the co-trained classifier rejects go), near duplicates (one document of each group stays),
decontamination (documents that hold benchmark items go), mixing (each document as often as its rate says) and the
token store (ids cut, stored once, read back and checked). Every stage takes (spark, docs, sf_dir); all but the last
return the columns of ``documents``.

Defined results: a null or empty text goes on through every stage that doesn't reject it by its quality, is no near
duplicate of anything and ends as one end id; rows of equal doc_id are judged each by its own text, and of rows with the
same doc_id and text one stays; a null doc_id is a document like any other; columns beside those of ``documents``, of any
name, go along up to the token store; empty tables make empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrata.llm import decontaminate, jaccard_join, mixing, quality_classifier, token_store
from narrata.llm.common import drop_folder, new_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-id store", tokens),
]

#: Trained models, alignment and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the next stage has read isn't needed any more
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
