"""Corpus pipeline over ``documents``: toxicity filter, exact dedup, near dedup, best-fit packing.

Each stage takes the documents that the stage before kept, reread from Parquet. Stages 1 to 3 return the columns of
``documents``; the last returns the packed pieces. Documents with null texts count as empty; a table without rows
gives a table without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import exact, near, queries, toxicity
from tickloom.session import shared_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; labels are learned from the given documents' own rows."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("text", *(c for c in docs.columns if c != "text")), model, name="__score__")
    return scored.filter("__score__ < 0.5").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest id."""
    kept = exact.exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__id__"), F.col("text_sha256").alias("__sha__"))
    met = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id__"))).filter(F.sha2(exact.ascii_lower(F.col("text")), 256) == F.col("__sha__"))
    return met.dropDuplicates(["__id__", "__sha__"]).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id. Null ids are all kept."""
    return near.kept_rows(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents in sequences of at most 2048 ids."""
    return queries.packed_documents(docs)


STAGES = [("toxicity", toxic), ("exact dedup", exact_copies), ("near dedup", near_copies), ("packing", packed)]

#: No SQL: learned weights, tokenizer ids and packing cannot be expressed; the tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
