"""Corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet in the shared
checkpoint folder and reads them again for the next.

Defined cases in every stage: null and empty texts are clean documents (of several, the
exact dedup keeps one, as of other equal texts); a null id is a document like others; an
empty table stays empty; extra columns pass through whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import exact_dedup, jaccard_join, packing, secrets, toxicity
from vitrine.llm.workers import importable
from vitrine.operators.lineage import materialize


@importable
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; without labels of both kinds none does."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


@importable
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays; of rows that repeat id and text, one."""
    return exact_dedup.without_copies(docs)


@importable
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id stays; texts without words and
    rows without an id link with nothing and stay."""
    gone = jaccard_join.jaccard_components(docs).filter("id <> component_id").select(F.col("id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


@importable
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, a null text as null; secrets are replaced by a mark."""
    return secrets.mask_secrets(docs)


@importable
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document with its place; a null or empty text is one piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the forest are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


@importable
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
