"""From raw documents to packed sequences, in five stages of which each calls one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, written
from marlstone.llm.jaccard import one_of_each
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.packing import pack_documents
from marlstone.llm.quality_classifier import good_documents, held_out, learned
from marlstone.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = learned(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return good_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return mask_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each time that it takes words of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the mixed documents with its sequence and offset."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]
#: Learned scores, connected components and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
