"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents,
whatever other columns these have. An empty table passes through every stage; long texts are
judged, compared, counted and packed whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireflow.llm.common import staged, table, unstage
from wireflow.llm.exact_dedup import keep_one
from wireflow.llm.host_rules import keep_good
from wireflow.llm.mixing import mixed_documents
from wireflow.llm.near_dedup import keep_one_of_each
from wireflow.llm.packing import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source is not rejected; those without words (null, empty or blank texts) go."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id (null ranks lowest); of tied rows the last read."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest doc_id (null ranks last); of tied rows the first read."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows equal in doc_id and text together, a null source as one of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is one token."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix sources", mix_sources), ("packing", packing)]

#: Neither consistent weighted sampling nor a tokenizer can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents table; a stage's output is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
        unstage(docs)
        docs = out
    return docs
