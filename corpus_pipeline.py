"""From raw documents to packed training sequences, stage by stage.

Each stage takes (session, the documents its predecessor kept, folder of the tables) and returns a DataFrame; ``run``
writes it as Parquet in the shared checkpoint folder and rereads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surfex.llm import best_fit, exact_dedup, partenum_join, quality_trees, secret_scan
from surfex.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees accept, learnt from the labelled rows that are not held out."""
    return quality_trees.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    return partenum_join.keep_one(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark."""
    return secret_scan.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: the sequence it goes to, where, and how long that sequence is."""
    return best_fit.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram jaccard join", near), ("secret scans", secrets), ("best-fit packing", packing)]

#: No SQL: trees are learnt, links are followed, bins are filled one piece after the other. The tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
