"""Exact deduplication by content hash with a byte comparison (DataFrame only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, saved, spread_join, table

HashOf = Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes, as hex."""
    return F.md5(text)


def keyed(docs: DataFrame, hash_of: HashOf) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_h", hash_of(F.col("_t")))


def copy_groups(rows: DataFrame) -> DataFrame:
    """One row for each distinct text of ``keyed`` rows: _h, _t, keep_id, group_size.

    Texts are grouped by (128-bit hash, text): equal keys are equal bytes, so two
    texts that collide stay apart. A group of copies collapses to one row in each
    map task, whatever its size.
    """
    return rows.groupBy("_h", "_t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, hash_of: HashOf = content_hash) -> DataFrame:
    """Group equal texts; of each group the row with the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256 with one row for each
    row of ``docs``. Null text counts as empty. Rows with a null doc_id belong to
    their text's group and are kept only where no row of the group has an id.
    Rows repeated with one id are each returned, with equal values. Other columns
    of ``docs`` are ignored, so their names can't clash. An empty table gives an
    empty result.

    The second scan carries only (doc_id, hash) through its shuffle, and deals the
    rows of a group with a large part of all rows to several tasks. Where two
    different texts share one hash, which the saved groups show, the rows of that
    hash alone are matched by their bytes as well.
    """
    rows = keyed(docs, hash_of)
    groups = saved(copy_groups(rows).select("_h", F.sha2("_t", 256).alias("text_sha256"), "keep_id", "group_size"))
    hot = hot_keys(groups.groupBy("_h").agg(F.sum("group_size").alias("n")), "_h")
    clash = groups.groupBy("_h").count().where("count > 1").select("_h")
    out = ["doc_id", "keep_id", "group_size", "text_sha256"]
    if clash.isEmpty():
        found = spread_join(rows.select("doc_id", "_h"), groups, "_h", hot, "doc_id").select(*out)
    else:
        single = groups.join(clash, "_h", "left_anti")
        inside = rows.join(clash, "_h", "left_semi")
        apart = copy_groups(inside).withColumn("text_sha256", F.sha2("_t", 256))
        found = spread_join(rows.select("doc_id", "_h"), single, "_h", hot, "doc_id").select(*out)
        found = found.unionByName(inside.join(apart, ["_h", "_t"]).select(*out))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, hash_of: HashOf = content_hash) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, one for each distinct text.

    All columns stay, whatever their names. Null text counts as empty. Where rows
    repeat with one id and one text, one of them stays. Of the rows without an id,
    one stays for each text that no row with an id has. An empty table gives an empty
    result. The row that stays travels with its group, so that a text is shuffled once.
    """
    other = [c for c in docs.columns if c.lower() != "text"]
    text, at = F.coalesce("text", F.lit("")), [c.lower() for c in other].index("doc_id")
    whole = F.struct(F.col("text").isNull().alias("blank"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(other)])
    groups = docs.select(hash_of(text).alias("h"), text.alias("t"), whole.alias("row")).groupBy("h", "t").agg(F.max_by("row", F.struct(f"row.c{at}")).alias("row"))
    value = {c: F.col(f"row.c{i}") for i, c in enumerate(other)}
    return groups.select(*[value[c].alias(c) if c in value else F.when(~F.col("row.blank"), F.col("t")).alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, sha256(d.t) AS text_sha256, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept
FROM d JOIN g ON d.t = g.t
"""
