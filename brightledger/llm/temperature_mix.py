"""Temperature mixing of sources, realised as budgeted block permutations (DataFrame only).

A source with share p of all tokens gets the weight p**a / sum(p**a). A smaller
exponent a flattens the mixture: its entropy rises, and so does the number of
passes over small sources. The smallest exponent within both limits is found by
bisection, a distributed aggregate over the table of sources at a time. Then each
source's documents are laid out pass after pass, each pass in an order of its own,
as far as the source's part of the token budget goes, and the layout is cut into
blocks that hold every source at its weight.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, saved, table

#: Halvings of the exponent's interval, and how many of them one pass over the sources decides.
HALVINGS, AT_A_TIME = 40, 4
#: Documents in one bucket of a source's order, at most 16 times as many.
BUCKET_DOCS = 1024
ENTROPY_SHARE, MOST_PASSES, BLOCK_TOKENS, SEED = 0.99, 4.0, 500_000, 11


def words(text: Column) -> Column:
    """Tokens of a text: its parts between spaces, at least 1."""
    given = F.coalesce(text, F.lit(""))
    return F.length(given) - F.length(F.replace(given, F.lit(" "), F.lit(""))) + F.lit(1)


def source_sizes(docs: DataFrame, tokens: Column) -> DataFrame:
    """_s, n (tokens), docs: one row for each source; a null source counts as the empty name."""
    return docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s")).agg(
        F.sum(tokens.cast("long")).alias("n"), F.count(F.lit(1)).alias("docs")
    )


def measured(sizes: DataFrame, total: int, largest: int, exponents: list[float], budget: int | None) -> list[tuple[float, float]]:
    """Entropy of the weights and most passes over a source, for each exponent; one aggregate for all."""
    share, columns = F.col("n") / F.lit(float(total)), []
    for i, a in enumerate(exponents):
        power = F.pow(share, F.lit(a))
        columns += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(power)).alias(f"e{i}"), F.max(power / share).alias(f"r{i}")]
    row = sizes.agg(*columns).first()
    found = []
    for i, a in enumerate(exponents):
        z = row[f"z{i}"]
        passes = row[f"r{i}"] / z * budget / total if budget else row[f"r{i}"] / (largest / total) ** (a - 1)
        found.append((math.log(z) - row[f"e{i}"] / z, passes))
    return found


def find_exponent(sizes: DataFrame, total: int, largest: int, entropy: float, most_passes: float, budget: int | None) -> float:
    """The smallest exponent from 0 to 1 whose entropy and passes keep to their limits, to 6 places.

    1, the sources as they are, where even that has more entropy than asked for.
    """
    kept = lambda exponents: [h <= entropy + 1e-9 and p <= most_passes + 1e-9 for h, p in measured(sizes, total, largest, exponents, budget)]
    if kept([0.0])[0]:
        return 0.0
    if budget and budget > most_passes * total:
        raise ValueError(f"a budget of {budget} tokens needs more than {most_passes} passes over {total}")
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AT_A_TIME):
        parts = 2**AT_A_TIME
        inner = [low + (high - low) * k / parts for k in range(1, parts)]
        fits = dict(zip(inner, kept(inner), strict=True))
        for _ in range(AT_A_TIME):
            middle = (low + high) / 2
            low, high = (low, middle) if fits[min(inner, key=lambda x: abs(x - middle))] else (middle, high)
    return round(high, 6)


def temperature_weights(
    docs: DataFrame, tokens: Column | None = None, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES, budget: int | None = None
) -> tuple[DataFrame, float, int]:
    """Weights of the sources, the exponent, and the token budget.

    The entropy may reach ``entropy_share`` of the logarithm of the number of
    sources, and no source is passed over more than ``most_passes`` times. Without
    a ``budget`` it is the smallest one with which every document is met at least
    once. The table has _s, n, docs, weight and part (the source's tokens).
    """
    sizes = saved(source_sizes(docs, words(F.col("text")) if tokens is None else tokens))
    number, total, largest = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if not total:
        return sizes.select("_s", "n", "docs", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("part")), 1.0, 0
    a = find_exponent(sizes, total, largest, entropy_share * math.log(number), most_passes, budget)
    power = F.pow(F.col("n") / F.lit(float(total)), F.lit(a))
    z = sizes.agg(F.sum(power)).first()[0]
    whole = budget or math.ceil(largest * z / (largest / total) ** a)
    part = F.round(F.col("weight") * F.lit(float(whole)), 0).cast("long")
    weighed = sizes.withColumn("weight", F.round(power / F.lit(z), 9))
    part = F.least(part, F.floor(F.col("n") * F.lit(most_passes)))
    return weighed.withColumn("part", part if budget else F.greatest("n", part)), a, whole


def order_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def totals_before(buckets: DataFrame) -> DataFrame:
    """_s, epoch, bucket and before: what the buckets (with ``held``) of a source's pass hold before each of them.

    Buckets are summed inside stretches that share the first half of their digits, and
    the stretches along the pass, so that a task sees about the root of their number.
    """
    cut = buckets.withColumn("stretch", F.substring("bucket", F.lit(1), F.ceil(F.length("bucket") / 2).cast("int")))
    earlier = lambda *keys, order: W.partitionBy("_s", "epoch", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda window: F.coalesce(F.sum("held").over(window), F.lit(0))
    stretches = cut.groupBy("_s", "epoch", "stretch").agg(F.sum("held").alias("held")).select("_s", "epoch", "stretch", so_far(earlier(order="stretch")).alias("start"))
    inside = cut.withColumn("own", so_far(earlier("stretch", order="bucket")))
    return inside.join(stretches, ["_s", "epoch", "stretch"]).select("_s", "epoch", "bucket", (F.col("start") + F.col("own")).alias("before"))


def temperature_mix(
    docs: DataFrame, tokens: Column | None = None, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES,
    budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """Where every document stands in the mixture.

    Returns doc_id, source, epoch (the pass over its source, from 0), block (from
    0), slot (from 1, in the block) and tokens: a row for each time that a document
    is met. A source's stream ends with the document that reaches its part of the
    budget. A null source counts as the empty name, a null or empty text as one
    token. Repeated rows are laid out one by one, in any order among themselves;
    ids may be null, and rows without one are ordered by a hash of their text. Other columns are ignored. An empty table gives no rows.

    A running sum over a source would put the largest source into one task. The
    order is therefore cut into buckets of about BUCKET_DOCS documents by the
    leading digits of its hash: sums inside buckets run apart, and only the
    buckets' totals are added up along a source. A block is bounded by its tokens.
    """
    count = words(F.col("text")) if tokens is None else tokens
    weights, _, whole = temperature_weights(docs, count, entropy_share, most_passes, budget)
    blocks = float(max(1, round(whole / block_tokens)))
    digits = F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log(F.col("docs") / BUCKET_DOCS) / math.log(16)))).cast("int")
    passes = F.ceil(F.col("part") / F.col("n")).cast("int")
    laid = (
        docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s"), count.cast("long").alias("tokens"), F.when(F.col("doc_id").isNull(), F.md5("text")).alias("own_hash"))
        .join(weights.select("_s", "n", "part", digits.alias("digits"), passes.alias("passes")), "_s")
        .where("passes > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("key", order_key(F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.col("own_hash"))))
        .withColumn("bucket", F.substring("key", F.lit(1), F.col("digits")))
    )
    bucket = ["_s", "epoch", "bucket"]
    before = totals_before(laid.groupBy(*bucket).agg(F.sum("tokens").alias("held")))
    inside = W.partitionBy(*bucket).orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        laid.withColumn("own", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(before, bucket)
        .withColumn("at", F.col("epoch") * F.col("n") + F.col("before") + F.col("own"))
        .where("at < part")
        .withColumn("block", F.floor(F.col("at").cast("double") / F.col("part") * F.lit(blocks)).cast("long"))
    )
    shuffled = W.partitionBy("block").orderBy(order_key(F.lit(seed), F.col("block"), F.col("epoch"), F.col("doc_id")), "doc_id", "epoch")
    return placed.select(
        "doc_id", F.col("_s").alias("source"), "epoch", "block", F.row_number().over(shuffled).alias("slot"), "tokens"
    )


def mixed_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture meets it, but at least once, laid out in the mixture's order.

    All columns stay, whatever their names. Rows are dealt into shards by a hash of
    their id, and each shard, a file when written, is sorted by block and slot: all
    shards go through the blocks in the same order, each with its share of every
    block. So a text is shuffled once, however often it is met. A row without an id is
    met once, in a block by a hash of its text; rows that share an id are each met as
    often as the id is. An empty table gives an empty result.
    """
    met = saved(temperature_mix(docs, **limits).where("doc_id IS NOT NULL").groupBy("doc_id", "epoch").agg(F.min(F.struct("block", "slot")).alias("at")))
    last = met.agg(F.max("at.block")).first()[0] or 0
    at, epoch = free_name(docs, "_at"), free_name(docs, "_epoch")
    met = met.select("doc_id", F.col("epoch").alias(epoch), F.col("at").alias(at))
    alone = F.struct(F.pmod(F.xxhash64("text"), F.lit(last + 1)).alias("block"), F.lit(0).alias("slot"))
    rows = docs.where("doc_id IS NOT NULL").join(met, "doc_id", "left").withColumn(at, F.coalesce(at, alone)).select(*docs.columns, at)
    rows = rows.unionByName(docs.where("doc_id IS NULL").withColumn(at, alone))
    return rows.sortWithinPartitions(f"{at}.block", f"{at}.slot").select(*docs.columns)


def op4_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS s, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) + 1 AS tokens FROM documents),
sz AS (SELECT s, sum(tokens)::BIGINT AS n, count(*) AS docs FROM d GROUP BY s),
tot AS (SELECT count(*) AS k, sum(n)::DOUBLE AS total, max(n)::DOUBLE AS top FROM sz),
sh AS (SELECT s, n, docs, n / total AS p, k, total, top FROM sz, tot),
bis(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) <= {ENTROPY_SHARE} * ln(max(k)) + 1e-9
      AND max(pow(p, (lo + hi) / 2) / p) / pow(max(top / total), (lo + hi) / 2 - 1) <= {MOST_PASSES} + 1e-9 AS ok
    FROM bis, sh WHERE step < {HALVINGS} GROUP BY step, lo, hi)),
ex AS (SELECT round(hi, 6) AS a FROM bis WHERE step = {HALVINGS}),
wt AS (SELECT s, n, docs, pow(p, a) / sum(pow(p, a)) OVER () AS w, ceil(top * sum(pow(p, a)) OVER () / pow(top / total, a)) AS whole FROM sh, ex),
pt AS (SELECT s, n, docs, whole, greatest(n, least(round(round(w, 9) * whole), floor(n * {MOST_PASSES}))::BIGINT) AS part FROM wt),
laid AS (SELECT doc_id, d.s, tokens, n, part, whole, epoch, md5(concat_ws('|', '{SEED}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS key
  FROM d JOIN pt ON d.s = pt.s, LATERAL (SELECT unnest(range(0, ceil(part / n)::BIGINT)) AS epoch)),
put AS (SELECT *, epoch * n + coalesce(sum(tokens) OVER (PARTITION BY s, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM laid),
bl AS (SELECT *, floor(pos::DOUBLE / part * greatest(1, round(whole / {BLOCK_TOKENS})))::BIGINT AS block FROM put WHERE pos < part)
SELECT doc_id, s AS source, epoch::INTEGER AS epoch, block,
  (row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', '{SEED}', block::VARCHAR, epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''))), doc_id, epoch))::INTEGER AS slot,
  tokens::BIGINT AS tokens
FROM bl
"""
