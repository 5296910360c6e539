"""Statement facts made of the order tables.

An entity is a nation, a scope an order status, a period the calendar year of the
order; concepts are sums of order and line amounts, exact decimals of two places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

MONEY = "decimal(18,2)"
SCOPES = {"F": "consolidated", "O": "parent"}
CONCEPTS = ["revenue", "cost", "inventory", "tax"]


def wide(spark: SparkSession, sf_dir: str, period: str = "year") -> DataFrame:
    """entity, scope, document_id, start, end and a column for each concept; lineitem is scanned once and summed before its join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("cost"), F.sum(F.col("l_quantity").cast(MONEY)).alias("inventory"),
        F.sum(F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast("decimal(4,2)")).alias("tax"),
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast(MONEY).alias("revenue"), F.to_date(F.trunc("o_orderdate", period)).alias("start"))
    scope = F.when(F.col("o_orderstatus") == "F", "consolidated").when(F.col("o_orderstatus") == "O", "parent").otherwise("unknown")
    months = {"year": 12, "quarter": 3}[period]
    joined = orders.join(owners, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    document = F.when(scope == "unknown", F.col("o_orderpriority")).otherwise("")
    grouped = joined.groupBy("entity", scope.alias("scope"), document.alias("document_id"), "start")
    return grouped.agg(*[F.sum(c).cast("decimal(28,4)").alias(c) for c in CONCEPTS]).withColumn("end", F.last_day(F.add_months("start", months - 1)))


def long(spark: SparkSession, sf_dir: str, period: str = "year") -> DataFrame:
    """The facts in long form, without blanks. Exploded from an array: behind unpivot, the generated code of a long projection doesn't compile."""
    pairs = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("value")) for c in CONCEPTS])
    return wide(spark, sf_dir, period).select("entity", "scope", "document_id", "start", "end", F.inline(pairs)).where("value IS NOT NULL")


def statement_facts(spark: SparkSession, sf_dir: str, period: str = "year", names: dict[str, str] | None = None) -> DataFrame:
    """The facts as rows of STATEMENT_FACT: flows of an income statement, and balances.

    ``names``: concept of the facts -> concept of a statement; revenue and cost are
    flows, all others balances at the period's end.
    """
    names = names or {"revenue": "revenue", "cost": "cost", "inventory": "inventory"}
    stock = ~F.col("concept").isin("revenue", "cost")
    key = F.concat_ws("/", "entity", "scope", "document_id", F.col("start").cast("string"))
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("concept")]
    return long(spark, sf_dir, period).where(F.col("concept").isin(list(names))).withColumn("concept", renamed).select(
        key.alias("statement_id"), F.concat_ws("/", key, "concept").alias("item_id"), F.concat(F.lit("d"), "document_id").alias("document_id"),
        F.when(stock, "balance_sheet").otherwise("income_statement").alias("statement_type"), "entity", "scope", F.lit("CNY").alias("currency"),
        F.when(~stock, F.col("start")).alias("period_start"), F.col("end").alias("period_end"), F.when(stock, "instant").otherwise(period).alias("period_kind"),
        F.year("start").cast("string").alias("period_raw"), "concept", F.col("concept").alias("source_name"), F.col("value").cast("string").alias("raw_value"), F.lit("元").alias("raw_unit"),
        F.col("value").cast("decimal(28,8)").alias("value"), F.lit("source_verified").alias("status"), F.lit("extracted").alias("statement_state"),
        F.array().cast("array<string>").alias("issues"), F.lit(True).alias("unit_known"),
    )


#: The same facts as DuckDB SQL, as CTEs ``f`` (wide) and ``fl`` (long).
SQL = """
li AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost, sum(CAST(l_quantity AS DECIMAL(18,2))) AS inventory,
    sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax FROM lineitem GROUP BY 1),
f AS (SELECT n_name AS entity, CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'parent' ELSE 'unknown' END AS scope,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN '' ELSE o_orderpriority END AS document_id, CAST(date_trunc('{period}', o_orderdate) AS DATE) AS "start",
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, sum(cost) AS cost, sum(inventory) AS inventory, sum(tax) AS tax
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN li ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
fl AS (SELECT entity, scope, document_id, "start", unnest(['revenue', 'cost', 'inventory', 'tax']) AS concept,
    unnest([CAST(revenue AS DOUBLE), CAST(cost AS DOUBLE), CAST(inventory AS DOUBLE), CAST(tax AS DOUBLE)]) AS value FROM f)
"""


def with_facts(body: str, period: str = "year") -> str:
    return "WITH " + SQL.replace("{period}", period) + body
