"""Sources: documents as whole texts, JSON batches, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import converter_for
from ..schemas import BENCHMARK_CELL, MANUAL_FACT


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text and tool of the files under a path, a row each, without a byte order mark; of kinds that need a converter the text is null."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.regexp_replace("value", "^﻿", "").alias("text"))
    named = files.withColumn("tool", converter_for(F.col("document_id")))
    return named.withColumn("text", F.when(F.col("tool") == "text", F.col("text")))


def benchmark_cells(spark: SparkSession, path: str) -> DataFrame:
    """Expected or actual cells of a benchmark: a JSON array of records a file; a broken file is kept in ``_corrupt``."""
    return spark.read.json(path, schema=f"{BENCHMARK_CELL}, _corrupt string", multiLine=True, columnNameOfCorruptRecord="_corrupt")


MOST_FACTS = 100


def import_faults(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """Why a batch of hand-entered facts (of ``proven_facts``) can't be imported: document_id and fault.

    ``revisions``: document_id and the revision on record. Faults: too_many_facts,
    stale_revision, unproven_fact (some fact isn't on its source line).
    """
    batch = facts.groupBy("document_id", "expected_revision").agg(F.count(F.lit(1)).alias("n"), F.bool_and("proven").alias("proven")).join(revisions, "document_id", "left")
    faults = F.array_compact(F.array(F.when(F.col("n") > MOST_FACTS, F.lit("too_many_facts")), F.when(~F.col("expected_revision").eqNullSafe(F.col("revision")), F.lit("stale_revision")), F.when(~F.col("proven"), F.lit("unproven_fact"))))
    return batch.select("document_id", F.explode(faults).alias("fault"))


def manual_facts(spark: SparkSession, path: str) -> DataFrame:
    """Hand-entered facts: document_id, sha256, reason, expected_revision and one row for each fact; a broken batch is kept in ``_corrupt``."""
    schema = f"document_id string, sha256 string, reason string, expected_revision int, facts array<struct<{MANUAL_FACT.replace(' ', ':').replace(',:', ',')}>>, _corrupt string"
    batch = spark.read.json(path, schema=schema, multiLine=True, columnNameOfCorruptRecord="_corrupt")
    return batch.select("document_id", "sha256", "reason", "expected_revision", "_corrupt", F.explode_outer("facts").alias("f")).select("document_id", "sha256", "reason", "expected_revision", "_corrupt", "f.*")


def proven_facts(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts with ``proven``: whether the cited line of the document is the quote and the document's hash is the one cited."""
    lines = docs.select("document_id", F.sha2("text", 256).alias("_sha"), F.posexplode(F.split("text", "\n")).alias("_n", "_line")).withColumn("line", F.col("_n") + 1)
    found = facts.join(lines.select("document_id", "line", "_sha", "_line"), ["document_id", "line"], "left")
    return found.withColumn("proven", F.coalesce((F.trim("_line") == F.trim("quote")) & (F.col("_sha") == F.col("sha256")), F.lit(False))).drop("_sha", "_line")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files whose content doesn't have the hash on record (name, sha256), and files that are missing."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_sha"))
    return expected.join(files, "name", "left").where(~F.col("_sha").eqNullSafe(F.col("sha256"))).select("name", "sha256", F.col("_sha").alias("found"))
