"""From raw documents to a clean, mixed and encoded corpus, stage by stage.

Counted as part of ``brightledger.llm``. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty
tables and further columns, as the docstring of the function that it calls says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightledger.llm.common import saved, table
from brightledger.llm.exact_dedup import drop_copies
from brightledger.llm.minhash_dedup import drop_near_copies
from brightledger.llm.sentencepiece_codec import sentencepiece_digests
from brightledger.llm.temperature_mix import mixed_documents
from brightledger.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents similar by shingles of five words, to 0.8 or more, the one with the smallest id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, in the mixture's order; those of small sources are repeated as the weights ask."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return sentencepiece_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
