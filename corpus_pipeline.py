"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the
last return the columns of ``docs``; the last returns one row per piece of a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oscilla.llm import exact_dedup, mixing, near_copies, packing, quality
from oscilla.llm.common import table
from oscilla.llm.queries import END_ID, tokenizer_path
from oscilla.session import durable, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    ship_package(spark)
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same normalised text one stays."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more on five words one document stays."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared out by temperature to 0.99 of the greatest entropy that unrepeated rows allow."""
    ship_package(spark)
    return mixing.draw(docs, target=0.99, repeats=1.0, kept=0.9, tokenizer=tokenizer_path())


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 1024 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_path(), END_ID).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed_sequences),
]

# fitted weights, fingerprints and packing are beyond SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
