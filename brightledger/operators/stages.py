"""Stages whose results are kept by content, so that only what changed is worked out again.

A result belongs to a signature, the digest of the stage's name, version and settings and
of the row's payload. A run signs its rows, leaves out those whose signature has a sound
result, charges the rest with an attempt before it starts, and appends what comes of
them. A signature with MOST_ATTEMPTS attempts and no result isn't tried again, whether
its attempts ended in an error or in a lost run. Both tables are only appended to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3
ATTEMPTS = "signature string, stage string, run string"
RESULTS = "signature string, stage string, run string, response string, response_sha256 string, error string"
#: A stage takes (signature, payload columns) and returns (signature, response, error); a response is JSON or any text.
Stage = Callable[[DataFrame], DataFrame]


def signature(stage: str, version: str, settings: dict[str, str], payload: list[str]) -> Column:
    """Digest of all that a result depends on."""
    parts = F.struct(F.lit(stage).alias("stage"), F.lit(version).alias("version"), F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())] or [F.lit(0).alias("none")]).alias("settings"), F.struct(*sorted(payload)).alias("payload"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def cache_state(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each signature that was tried: stage, state, attempts, response and last_error.

    A result whose digest isn't the recorded one doesn't count: state stage_cache_invalid.
    Equal results of several runs are one; of different ones the smallest counts.
    """
    attempts = _read(spark, f"{folder}/attempts", ATTEMPTS).groupBy("signature", "stage").agg(F.count(F.lit(1)).alias("attempts"))
    sound = F.sha2("response", 256) == F.col("response_sha256")
    results = _read(spark, f"{folder}/results", RESULTS).groupBy("signature").agg(
        F.min(F.when(sound, F.col("response"))).alias("response"), F.bool_or(~sound).alias("broken"), F.max(F.when(F.col("response").isNull(), F.struct("run", "error")))["error"].alias("last_error")
    )
    state = (
        F.when(F.col("response").isNotNull(), "completed").when(F.coalesce("broken", F.lit(False)), "stage_cache_invalid")
        .when(F.col("attempts") >= MOST_ATTEMPTS, "stage_attempt_limit_exceeded").when(F.col("last_error").isNotNull(), "failed").otherwise("pending")
    )
    return attempts.join(results, "signature", "left").select("signature", "stage", state.alias("state"), "attempts", "response", F.when(F.col("response").isNull(), F.col("last_error")).alias("last_error"))


def run_stage(rows: DataFrame, folder: str, stage: str, version: str, work: Stage, payload: list[str], settings: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with signature, state, response, attempts, last_error and reused, of the stage kept in ``folder``.

    Equal payloads are worked out once. ``work`` gets no row whose result is there. A
    row of ``work`` with a null response is a failure with its error, as is a signature
    that it returns nothing for; of several rows of one signature the smallest response
    counts. ``reused``: the result was there before this run. Rows keep their columns,
    which mustn't have these names. Null payloads are payloads like others.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    signed = rows.withColumn("signature", signature(stage, version, settings or {}, payload))
    known = cache_state(spark, folder).where(F.col("state").isin("completed", "stage_attempt_limit_exceeded", "stage_cache_invalid")).select("signature")
    due = signed.select("signature", *payload).dropDuplicates(["signature"]).join(known, "signature", "left_anti")
    path = f"{folder}/due/{run}"
    due.write.parquet(path)  # the rows of this run are settled before they are charged
    due = spark.read.schema(due.schema).parquet(path)
    due.select("signature", F.lit(stage).alias("stage"), F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/attempts")
    done = work(due).groupBy("signature").agg(F.min("response").alias("response"), F.max("error").alias("error"))
    out = due.select("signature").join(done, "signature", "left").select(
        "signature", F.lit(stage).alias("stage"), F.lit(run).alias("run"), "response", F.sha2("response", 256).alias("response_sha256"),
        F.when(F.col("response").isNull(), F.coalesce("error", F.lit("stage_response_missing"))).alias("error"),
    )
    out.write.mode("append").parquet(f"{folder}/results")
    fresh = spark.read.schema(RESULTS).parquet(f"{folder}/results").where(F.col("run") == run).select("signature", F.lit(False).alias("_old"))
    told = cache_state(spark, folder).drop("stage").join(fresh, "signature", "left")
    reused = (F.col("state") == "completed") & F.coalesce("_old", F.lit(True))
    return signed.join(told, "signature").withColumn("reused", reused).drop("_old")


def work_done(spark: SparkSession, folder: str) -> DataFrame:
    """stage, run and inputs: how many inputs each run worked out."""
    return _read(spark, f"{folder}/attempts", ATTEMPTS).groupBy("stage", "run").agg(F.count(F.lit(1)).alias("inputs"))
