"""Queries over the tables: facts, metrics, aggregates, matrices, ordered operators, joins, scalars, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..operators import checks, documents, matrix, merging, metrics, modules, tables
from ..operators.metric_catalogue import BS, CATALOGUE
from ..operators.metrics import NEGATIVE, UNCLEAR, ZERO
from ..sources.readers import table
from ..streaming import events as streams
from . import facts
from .facts import with_facts
from .registry import ORACLE_SQL, QUERIES, example, query

DOUBLE = "double"


def iso(name: str):
    return F.col(name).cast("string")


# Facts and metrics -------------------------------------------------------------


@query(with_facts("SELECT entity, scope, document_id, CAST(\"start\" AS VARCHAR) AS period, concept, value FROM fl"))
def facts_long(spark, d):
    return facts.long(spark, d).select("entity", "scope", "document_id", iso("start").alias("period"), "concept", F.col("value").cast(DOUBLE).alias("value"))


@query(with_facts("SELECT entity, scope, document_id, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue FROM f GROUP BY 1, 2, 3"))
def group_key_isolation(spark, d):
    return facts.wide(spark, d).groupBy("entity", "scope", "document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").cast(DOUBLE).alias("revenue"))


_METRIC = """, m AS (SELECT a.entity, a.scope, a.document_id, CAST(a."start" AS VARCHAR) AS period, {value} AS v, {reason} AS r {source})
SELECT entity, scope, document_id, period, CASE WHEN r IS NULL THEN round(v, 6) END AS value, r AS reason FROM m"""


def _metric(spark, d, code):
    cells = metrics.metric_cells(facts.statement_facts(spark, d), [code]).where("kind = 'year'")
    return cells.select("entity", "scope", F.substring("document_key", 2, 99).alias("document_id"), iso("start").alias("period"), F.round(F.col("value").cast(DOUBLE), 6).alias("value"), "reason")


_UNKNOWN = "CASE WHEN a.scope = 'unknown' THEN '主体、范围、期间或单位口径待确认' END"


def _missing(label: str, shown: str, absent: str) -> str:
    return f"CASE WHEN a.scope = 'unknown' THEN '主体、范围、期间或单位口径待确认' WHEN {absent} THEN '缺少输入：{label}（' || {shown} || '）' END"


@query(with_facts(_METRIC.format(value="CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100", reason=_UNKNOWN, source="FROM f a")))
def metric_gross_margin(spark, d):
    return _metric(spark, d, "gross_margin")


@query(with_facts(_METRIC.format(
    value="CAST(a.revenue - b.revenue AS DOUBLE) / abs(CAST(b.revenue AS DOUBLE)) * 100",
    reason=_missing("营业收入", "(year(a.\"start\") - 1) || '-01-01/' || (year(a.\"start\") - 1) || '-12-31'", "b.entity IS NULL"),
    source="FROM f a LEFT JOIN f b ON a.entity = b.entity AND a.scope = b.scope AND a.document_id = b.document_id AND year(b.\"start\") = year(a.\"start\") - 1")))
def metric_yoy(spark, d):
    return _metric(spark, d, "revenue_growth")


@query(with_facts(_METRIC.format(
    value="CAST(a.cost AS DOUBLE) / (CAST(a.inventory + b.inventory AS DOUBLE) / 2)",
    reason=_missing("存货", "(year(a.\"start\") - 1) || '-12-31'", "b.entity IS NULL"),
    source="FROM f a LEFT JOIN f b ON a.entity = b.entity AND a.scope = b.scope AND a.document_id = b.document_id AND year(b.\"start\") = year(a.\"start\") - 1")))
def metric_avg_turnover(spark, d):
    return _metric(spark, d, "inventory_turnover")


@query(with_facts(_METRIC.format(
    value="360 / (CAST(a.cost AS DOUBLE) / (CAST(a.inventory + b.inventory AS DOUBLE) / 2))",
    reason=_missing("存货", "(year(a.\"start\") - 1) || '-12-31'", "b.entity IS NULL"),
    source="FROM f a LEFT JOIN f b ON a.entity = b.entity AND a.scope = b.scope AND a.document_id = b.document_id AND year(b.\"start\") = year(a.\"start\") - 1")))
def metric_days_30_360(spark, d):
    return _metric(spark, d, "inventory_turnover_days")


_BEFORE = "FROM f a LEFT JOIN f b ON a.entity = b.entity AND a.scope = b.scope AND a.document_id = b.document_id AND {on}"


def _balances(spark, d, code, names, period="year"):
    cells = metrics.metric_cells(facts.statement_facts(spark, d, period, names), [code]).where(F.col("kind") == period)
    return cells.select("entity", "scope", F.substring("document_key", 2, 99).alias("document_id"), iso("start").alias("period"), F.round(F.col("value").cast(DOUBLE), 6).alias("value"), "reason")


@query(with_facts(_METRIC.format(
    value="CAST(a.inventory - b.inventory AS DOUBLE) / abs(CAST(b.inventory AS DOUBLE)) * 100", reason=_missing("资产总计", "CAST(CAST(a.\"start\" AS DATE) - 1 AS VARCHAR)", "b.entity IS NULL"),
    source=_BEFORE.format(on="b.\"start\" = CAST(a.\"start\" - INTERVAL 3 MONTH AS DATE)")), "quarter"))
def metric_qoq(spark, d):
    return _balances(spark, d, "total_assets_quarter_growth", {"revenue": "revenue", "inventory": "total_assets"}, "quarter")


@query(with_facts(_METRIC.format(
    value="CAST(a.inventory - b.inventory AS DOUBLE) / abs(CAST(b.inventory AS DOUBLE)) * 100", reason=_missing("资产总计", "(year(a.\"start\") - 1) || '-12-31'", "b.entity IS NULL"),
    source=_BEFORE.format(on="year(b.\"start\") = year(a.\"start\") - 1"))))
def metric_opening_growth(spark, d):
    return _balances(spark, d, "total_assets_opening_growth", {"revenue": "revenue", "inventory": "total_assets"})


@query(with_facts(_METRIC.format(
    value="360 * (CAST(a.inventory + b.inventory AS DOUBLE) / 2 / CAST(a.cost AS DOUBLE) + CAST(a.tax + b.tax AS DOUBLE) / 2 / CAST(a.revenue AS DOUBLE))",
    reason=_missing("存货", "(year(a.\"start\") - 1) || '-12-31'", "b.entity IS NULL"), source=_BEFORE.format(on="year(b.\"start\") = year(a.\"start\") - 1"))))
def metric_operating_cycle(spark, d):
    return _balances(spark, d, "operating_cycle", {"revenue": "revenue", "cost": "cost", "inventory": "inventory", "tax": "accounts_receivable"})


_FLOWS, _STOCKS = ["revenue", "cost"], ["inventory"]


def _input_sql(x) -> tuple[str, str]:
    """(amount, period) of a metric's input where the facts are years of revenue, cost and inventory: a is the column's year, b the one before."""
    year, flow = "year(a.\"start\")", x.table != BS
    back = f"({year} - 1)" if x.offset in ("opening", "previous") else year
    known = x.concept in (_FLOWS if flow else _STOCKS) and x.offset != "previous_quarter" and not (flow and x.offset == "opening")
    amount = f"CAST({'b' if x.offset in ('opening', 'previous') else 'a'}.{x.concept} AS DOUBLE)" if known else "CAST(NULL AS DOUBLE)"
    end = f"{year} || '-09-30'" if x.offset == "previous_quarter" else f"{back} || '-12-31'"
    return amount, f"{back} || '-01-01/' || {end}" if flow else end


def _metric_sql(m) -> str:
    """One formula over the columns, from its definition: the first input that can't be used gives the reason, then the first denominator."""
    given = [_input_sql(x) for x in m.inputs]
    fails = [f"CASE WHEN {v} IS NULL THEN '缺少输入：{x.label}（' || {p} || '）' WHEN a.scope = 'unknown' THEN '{UNCLEAR}' END" for x, (v, p) in zip(m.inputs, given, strict=True)]
    used = [f"CASE WHEN {v} IS NOT NULL AND coalesce({', '.join([*fails[:k], 'NULL', 'NULL'])}) IS NULL THEN 1 ELSE 0 END" for k, (v, _) in enumerate(given)]
    names = {str(i): f"({v})" for i, (v, _) in enumerate(given)} | {"days": "360.0"}
    guards = []
    for i, (top, bottom) in enumerate(m.ratios):
        top, bottom = _named(top, names), _named(bottom, names)
        guards += [f"WHEN {bottom} = 0 THEN '{ZERO}'", f"WHEN {bottom} < 0 THEN '{NEGATIVE}'"]
        names[f"r{i}"] = f"(({top}) / nullif({bottom}, 0))"
    guard = f"CASE {' '.join(guards)} END" if guards else "NULL"
    return f"""SELECT a.entity, a.scope, CASE a.scope WHEN 'unknown' THEN 'd' || a.document_id ELSE '' END AS document_key, CAST(a."start" AS VARCHAR) AS "start", year(a."start") || '-12-31' AS "end", '{m.code}' AS code, '{m.category}' AS category, '{m.unit}' AS unit,
 CAST(coalesce({', '.join([*fails, guard, 'NULL'])}) AS VARCHAR) AS reason, {f'round({_named(m.value, names)}, 10)' if m.ratios else _named(m.value, names)} AS v, {' + '.join(used)} AS inputs FROM f AS a LEFT JOIN f AS b ON b.entity = a.entity AND b.scope = a.scope AND b.document_id = a.document_id AND year(b."start") = year(a."start") - 1"""


def _named(text: str, names: dict[str, str]) -> str:
    for name, sql in names.items():
        text = text.replace("{" + name + "}", sql)
    return text


@query(with_facts("SELECT entity, scope, document_key, \"start\", \"end\", 'year' AS kind, code, category, unit, CASE WHEN reason IS NULL THEN v END AS value, reason, CASE WHEN reason IS NULL THEN 'pending_review' ELSE 'unavailable' END AS status, inputs FROM ("
    + " UNION ALL ".join(map(_metric_sql, CATALOGUE)) + ")"))
def metrics_all(spark, d):
    cells = metrics.metric_cells(facts.statement_facts(spark, d))
    return cells.select("entity", "scope", "document_key", iso("start").alias("start"), iso("end").alias("end"), "kind", "code", "category", "unit", F.col("value").cast(DOUBLE).alias("value"), "reason", "status", F.size("inputs").alias("inputs"))


@query(with_facts("""SELECT entity, scope, document_id, CAST("start" AS VARCHAR) AS period,
 CASE WHEN scope <> 'unknown' THEN entity || '/' || scope || '/' || document_id || '/' || "start" || '/cost,' || entity || '/' || scope || '/' || document_id || '/' || "start" || '/revenue' ELSE entity || '/' || scope || '/' || document_id || '/' || "start" || '/cost' END AS inputs
 FROM f"""))
def metric_lineage(spark, d):
    cells = metrics.metric_cells(facts.statement_facts(spark, d), ["cost_rate"]).where("kind = 'year'")
    return cells.select("entity", "scope", F.substring("document_key", 2, 99).alias("document_id"), iso("start").alias("period"), F.array_join(F.array_sort(F.transform("inputs", lambda x: x["item_id"])), ",").alias("inputs"))


_CHECKED = """, o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, (SELECT sum(CAST(l_extendedprice AS DECIMAL(18,2))) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders)
SELECT o_orderkey, CASE WHEN lines IS NULL THEN 'not_checked_missing_disclosure' WHEN abs(lines - total) <= 0.01 THEN 'passed' ELSE 'conflict' END AS status,
 CASE WHEN lines IS NOT NULL THEN CAST(lines - total AS DOUBLE) END AS difference FROM o"""


@query("WITH x AS (SELECT 1)" + _CHECKED)
def check_identity_tolerance(spark, d):
    total = table(spark, d, "orders").select("o_orderkey", F.lit("total").alias("concept"), F.col("o_totalprice").cast("decimal(28,8)").alias("value"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast(facts.MONEY)).cast("decimal(28,8)").alias("value")).withColumn("concept", F.lit("lines"))
    items = total.unionByName(lines).withColumns({"statement_type": F.lit("order"), "raw_unit": F.lit("元"), "source_increment": F.lit("0.01"), "status": F.lit("source_verified"), "mapping_state": F.lit("mapped")})
    out = checks.statement_checks(items, ["o_orderkey"], {"order": {"lines_equal_total": {"lines": 1, "total": -1}}})
    return out.select("o_orderkey", "status", F.col("difference").cast(DOUBLE).alias("difference"))


# Aggregates --------------------------------------------------------------------


@query("""SELECT user_id, event_type, CASE WHEN count(DISTINCT CAST(value AS DECIMAL(18,1))) = 1 THEN CAST(min(CAST(value AS DECIMAL(18,1))) AS DOUBLE) END AS value,
 count(DISTINCT CAST(value AS DECIMAL(18,1))) > 1 AS conflict, count(value) AS candidates FROM events GROUP BY 1, 2""")
def distinct_or_conflict(spark, d):
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,1)"))
    return tables.distinct_or_conflict(e, ["user_id", "event_type"], "value").withColumn("value", F.col("value").cast(DOUBLE))


@query("""WITH c AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'human_confirmed' WHEN 'O' THEN 'source_verified' ELSE 'human_rejected' END AS s,
   CAST(floor(o_totalprice / 100000) AS BIGINT) AS v FROM orders),
 g AS (SELECT o_custkey, count(*) FILTER (s <> 'human_rejected') AS live, count(DISTINCT v) FILTER (s <> 'human_rejected') AS k,
   min(v) FILTER (s <> 'human_rejected') AS m, coalesce(bool_and(s = 'human_confirmed') FILTER (s <> 'human_rejected'), false) AS confirmed FROM c GROUP BY 1),
 t AS (SELECT *, CASE WHEN live = 0 THEN 'rejected' WHEN k > 1 THEN 'conflict' WHEN NOT confirmed THEN 'pending' ELSE 'value' END AS state FROM g)
 SELECT o_custkey, state, CASE WHEN state IN ('pending', 'value') THEN m END AS value, confirmed FROM t""")
def cell_state(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "human_confirmed").when(F.col("o_orderstatus") == "O", "source_verified").otherwise("human_rejected")
    cells = table(spark, d, "orders").select("o_custkey", status.alias("status"), F.floor(F.col("o_totalprice") / 100000).alias("value"))
    return tables.cell_state(cells, ["o_custkey"])


@query("""WITH s AS (SELECT l_partkey, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, CASE WHEN count(DISTINCT q) = 1 THEN CAST(min(q) AS BIGINT) END AS value, count(DISTINCT q) > 1 AS conflict, count(q) AS candidates FROM s GROUP BY 1""")
def two_phase_sum_conflict(spark, d):
    lines = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return tables.two_phase_sum(lines, ["l_partkey"], "l_suppkey", "q")


@query("""SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS digest, count(*) AS n FROM orders GROUP BY 1""")
def content_digest(spark, d):
    orders = table(spark, d, "orders")
    return tables.digest_of_group(orders, ["o_custkey"], F.col("o_orderkey"), F.col("o_orderstatus"))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) FILTER (value IS NULL) AS blank, count(*) AS n, round(median(value), 6) AS median FROM events GROUP BY 1""")
def conditional_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value").isNull()).alias("blank"), F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("median"))


@query("""SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS segment,
 round(CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) / nullif(count(*), 0), 9) AS negative_share FROM customer GROUP BY 1""")
def unique_or_null(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(tables.unique_or_null("c_mktsegment").alias("segment"), F.round(F.try_divide(F.count_if(F.col("c_acctbal") < 0).cast(DOUBLE), F.count(F.lit(1))), 9).alias("negative_share"))


# Matrices ----------------------------------------------------------------------

@query(with_facts("""SELECT g.entity, g.scope, y.y, CAST(sum(revenue) AS DOUBLE) AS revenue FROM (SELECT DISTINCT entity, scope FROM f) g CROSS JOIN (SELECT DISTINCT year("start") AS y FROM f) y
 LEFT JOIN f ON f.entity = g.entity AND f.scope = g.scope AND year(f."start") = y.y GROUP BY 1, 2, 3"""))
def matrix_pivot(spark, d):
    f = facts.wide(spark, d).select("entity", "scope", F.year("start").alias("y"), "revenue")
    years = [r["y"] for r in table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]  # the columns of the result: one a year
    out = matrix.pivoted(f, ["entity", "scope"], "y", years, F.sum("revenue"))
    cells = F.array(*[F.struct(F.lit(y).alias("y"), F.col(str(y)).cast(DOUBLE).alias("revenue")) for y in years])
    return out.select("entity", "scope", F.explode(cells).alias("c")).select("entity", "scope", "c.*")


@query("""SELECT p_partkey, unnest(['p_brand', 'p_name', 'p_type']) AS key, unnest([p_brand, p_name, p_type]) AS value FROM part""")
def matrix_unpivot(spark, d):
    return matrix.unpivoted(table(spark, d, "part"), ["p_partkey"], ["p_brand", "p_name", "p_type"])


@query(with_facts("""SELECT field, y, value FROM (SELECT year("start") AS y, unnest(['cost', 'revenue']) AS field, unnest([CAST(sum(cost) AS DOUBLE), CAST(sum(revenue) AS DOUBLE)]) AS value FROM f GROUP BY "start")"""))
def matrix_transpose(spark, d):
    f = facts.wide(spark, d).groupBy(F.year("start").alias("y")).agg(F.sum("cost").cast(DOUBLE).alias("cost"), F.sum("revenue").cast(DOUBLE).alias("revenue"))
    years = [r["y"] for r in f.select("y").distinct().orderBy("y").collect()]  # the columns of the result: one a year
    out = matrix.transposed(f, "y", ["cost", "revenue"], years)
    return out.select("field", F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(str(y)).alias("value")) for y in years])).alias("x")).select("field", "x.*")


@query("""SELECT p_brand, p_size, CASE WHEN p_size % 7 = 0 THEN '-' WHEN p_size % 5 = 0 THEN '0' ELSE '' END AS cell, count(*) AS n FROM part
 WHERE p_size IN (SELECT p_size FROM part WHERE p_size % 7 <> 0 AND p_size % 5 = 0) GROUP BY 1, 2, 3""")
def hide_empty_rows(spark, d):
    cell = F.when(F.col("p_size") % 7 == 0, "-").when(F.col("p_size") % 5 == 0, "0").otherwise("")
    cells = table(spark, d, "part").groupBy("p_brand", "p_size", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return matrix.hide_empty_rows(cells, ["p_size"], "cell").select("p_brand", "p_size", "cell", "n")


@query(with_facts("""SELECT entity, scope, document_id, CAST(last_day("start" + INTERVAL 2 MONTH) AS VARCHAR) AS period, CAST(revenue AS DOUBLE) AS revenue FROM f
 WHERE month("start") = 10 OR "start" = (SELECT max("start") FROM f)""", "quarter"))
def report_filter_multi(spark, d):
    out = matrix.report_filter(facts.wide(spark, d, "quarter"), "end", "annual,latest")
    return out.select("entity", "scope", "document_id", iso("end").alias("period"), F.col("revenue").cast(DOUBLE).alias("revenue"))


@query(with_facts("""SELECT entity, scope, document_id, CAST("start" AS VARCHAR) AS period, CAST(revenue AS DOUBLE) AS revenue FROM (
 SELECT *, year("start") * 4 + quarter("start") AS q, max(year("start") * 4 + quarter("start")) OVER (PARTITION BY entity, scope, document_id) AS top FROM f) WHERE q > top - 12""", "quarter"))
def rolling_window_years(spark, d):
    out = matrix.rolling_years(facts.wide(spark, d, "quarter"), "end", ["entity", "scope", "document_id"], 3)
    return out.select("entity", "scope", "document_id", iso("start").alias("period"), F.col("revenue").cast(DOUBLE).alias("revenue"))


@example("""WITH c AS (SELECT unnest(['合并期末', '合并期末同比(%)', '母公司期末', '母公司期初环比(%)', '同比']) AS name)
 SELECT name, CASE name WHEN '同比' THEN '' ELSE regexp_extract(name, '^(合并|母公司)期[初末]', 0) END AS scope,
 CASE name WHEN '合并期末同比(%)' THEN '同比增长率' WHEN '母公司期初环比(%)' THEN '环比增长率' WHEN '同比' THEN '同比' ELSE '原始报表' END AS kind FROM c""")
def scope_kind_filter(spark, d):
    names = spark.createDataFrame([(x,) for x in ["合并期末", "合并期末同比(%)", "母公司期末", "母公司期初环比(%)", "同比"]], "name string")
    scope, kind = matrix.scope_and_kind(F.col("name"))
    return names.select("name", scope.alias("scope"), kind.alias("kind"))


# Ordered operators -------------------------------------------------------------


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_key(spark, d):
    return tables.latest_per_key(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def carry_forward_section(spark, d):
    c = table(spark, d, "conversations")
    mark = F.when(F.col("role") != "assistant", F.concat("role", F.col("turn").cast("string")))
    return c.select("conv_id", "turn", tables.carry_forward(c, ["conv_id"], ["turn"], mark).alias("section"))


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
 SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def run_grouping(spark, d):
    return tables.run_groups(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events""")
def rate_window(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", tables.rolling_count(["user_id"], "ts", 3600).alias("n"))


@query("""WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events WHERE event_id % 2 = 0),
 b AS (SELECT user_id, event_type, event_id AS other_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events WHERE event_id % 2 = 1)
 SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CAST(coalesce(a.occurrence, b.occurrence) AS INTEGER) AS occurrence, event_id, other_id
 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.occurrence = b.occurrence""")
def occurrence_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    right = e.where("event_id % 2 = 1").withColumnRenamed("event_id", "other_id")
    return tables.occurrence_join(e.where("event_id % 2 = 0"), right, ["user_id", "event_type"], ["event_id"], ["other_id"]).select("user_id", "event_type", "occurrence", "event_id", "other_id")


@query(with_facts("""SELECT entity, scope, document_id, CAST("start" AS VARCHAR) AS period, CAST(year("start") * 10 + CASE quarter("start") WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS report_order,
 CASE scope WHEN 'consolidated' THEN 1 WHEN 'parent' THEN 2 ELSE 3 END AS scope_order FROM f""", "quarter"))
def report_order_sort(spark, d):
    order = F.array_position(F.array(F.lit("consolidated"), F.lit("parent"), F.lit("unknown")), F.col("scope")).cast("int")
    return facts.wide(spark, d, "quarter").select("entity", "scope", "document_id", iso("start").alias("period"), P.report_order(F.col("end")).alias("report_order"), order.alias("scope_order")).orderBy("scope_order", F.desc("report_order"), "entity", "document_id")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 5""")
def topk_per_group(spark, d):
    by = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.withColumn("place", F.row_number().over(by)).where("place <= 5").drop("l_extendedprice")


# Joins and sets ----------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join_active(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_uncovered(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 1 THEN min(l_partkey) END AS l_partkey, count(l_orderkey) AS matches FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def unique_match_join(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return tables.unique_match(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"])


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS v FROM lineitem WHERE l_partkey % 10 <> 0),
 a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END END AS v FROM lineitem WHERE l_partkey % 13 <> 0)
 SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.l_linenumber, a.l_linenumber) AS l_linenumber, e.v AS expected, a.v AS actual,
 CASE WHEN e.v IS NULL AND a.v IS NULL THEN 'both_blank' WHEN e.v IS NULL THEN 'extra' WHEN a.v IS NULL THEN 'missing' WHEN e.v = a.v THEN 'equal' ELSE 'different' END AS outcome
 FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_linenumber = a.l_linenumber""")
def full_outer_reconcile(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("value"))
    changed = F.when(F.col("l_partkey") % 7 != 0, F.col("value") + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0))
    return tables.reconcile(lines.where("l_partkey % 10 <> 0"), lines.where("l_partkey % 13 <> 0").withColumn("value", changed), ["l_orderkey", "l_linenumber"])


@query("""SELECT e.event_id, s.event_id AS span_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'purchase' AND s.event_id - 50 <= e.event_id AND e.event_id + 3 <= s.event_id + 50""")
def interval_containment(spark, d):
    e = table(spark, d, "events")
    points = e.select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("end"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), (F.col("event_id") - 50).alias("l"), (F.col("event_id") + 50).alias("r"))
    return tables.contained(points, spans, ["user_id"], 100).select(F.col("start").alias("event_id"), "span_id")


@query("""SELECT doc_id, 'd' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def set_operations(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("d")).unionByName(docs.intersect(labels).withColumn("side", F.lit("both")))


@query("""WITH a AS (SELECT 'orders' AS source, o_custkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderpriority AS note FROM orders UNION ALL SELECT 'customer', c_custkey, CAST(c_acctbal AS DECIMAL(18,2)), NULL FROM customer)
 SELECT source, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total, count(note) AS notes FROM a GROUP BY 1""")
def union_sources(spark, d):
    orders = table(spark, d, "orders").select(F.lit("orders").alias("source"), F.col("o_custkey").alias("id"), F.col("o_totalprice").cast(facts.MONEY).alias("v"), F.col("o_orderpriority").alias("note"))
    owners = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast(facts.MONEY).alias("v"))
    return orders.unionByName(owners, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast(DOUBLE).alias("total"), F.count("note").alias("notes"))


_SIDES = """lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2),
 e AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS VARCHAR) AS table_id, l_linenumber AS source_row, CAST(l_suppkey AS VARCHAR) AS company_id, l_returnflag AS statement_type,
   CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 'c' || l_partkey % 50 END AS concept, CAST(year(l_shipdate) AS VARCHAR) AS period, l_linestatus AS scope, 'CNY' AS currency, '1' AS unit_scale,
   CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value FROM lines WHERE l_partkey % 10 <> 0),
 a AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS VARCHAR) AS table_id, l_linenumber AS source_row, CAST(l_suppkey AS VARCHAR) AS company_id, CASE WHEN l_partkey % 17 = 0 THEN 'X' ELSE l_returnflag END AS statement_type,
   CASE WHEN l_partkey % 11 = 0 THEN 'other' ELSE 'c' || l_partkey % 50 END AS concept, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS VARCHAR) END AS period, l_linestatus AS scope,
   CASE WHEN l_partkey % 6 = 0 THEN 'USD' ELSE 'CNY' END AS currency, '1' AS unit_scale, CASE WHEN l_partkey % 19 = 0 THEN 'x' ELSE CAST(l_quantity AS BIGINT) || '.00' END AS value,
   CASE WHEN l_partkey % 4 = 0 THEN 'GAP' ELSE 'VERIFIED' END AS state FROM lines WHERE l_partkey % 13 <> 0)"""


@query("WITH " + _SIDES + """, j AS (SELECT e.document_id IS NOT NULL AS w, a.document_id IS NOT NULL AS f, e.value AS ev, e.concept AS ec, e.period AS ep, e.scope AS es, e.currency AS eu, a.value AS av, a.concept AS ac, a.period AS ap, a.scope AS ascope, a.currency AS au, a.state,
   coalesce(TRY_CAST(e.value AS DECIMAL(38,12)) = TRY_CAST(a.value AS DECIMAL(38,12)), false) AS num, e.statement_type = a.statement_type AS st, e.company_id = a.company_id AS co
   FROM e FULL JOIN a ON e.document_id = a.document_id AND e.table_id = a.table_id AND e.source_row = a.source_row),
 t AS (SELECT count(*) FILTER (w) AS n, count(*) FILTER (w AND f AND ap IS NOT NULL) AS pc, count(*) FILTER (w AND f AND ap = ep) AS pr, count(*) FILTER (w AND f AND ascope IS NOT NULL) AS sc, count(*) FILTER (w AND f AND ascope = es) AS sr,
   count(*) FILTER (w AND f) AS uc, count(*) FILTER (w AND f AND au = eu) AS ur, count(*) FILTER (w AND ec IS NOT NULL) AS cn, count(*) FILTER (w AND f AND ec = ac) AS cr, count(*) FILTER (w AND ev IS NOT NULL) AS nn,
   count(*) FILTER (w AND f AND ev IS NOT NULL AND av IS NOT NULL) AS nc, count(*) FILTER (w AND f AND num AND ap IS NOT DISTINCT FROM ep AND es = ascope AND eu = au) AS nr, count(*) FILTER (f AND state = 'VERIFIED') AS vn,
   count(*) FILTER (f AND state = 'VERIFIED' AND NOT coalesce(w AND num AND st AND co AND ec IS NOT DISTINCT FROM ac AND ep IS NOT DISTINCT FROM ap AND es = ascope AND eu = au, false)) AS vf FROM j),
 d AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT document_id, table_id, statement_type FROM e)) AS dn, (SELECT count(*) FROM (SELECT document_id, table_id, statement_type FROM e INTERSECT SELECT document_id, table_id, statement_type FROM a)) AS dr)
 SELECT m AS metric, x AS numerator, y AS denominator, c AS coverage_numerator, CASE WHEN c IS NOT NULL THEN y END AS coverage_denominator, CAST(x AS DOUBLE) / nullif(y, 0) AS value FROM (
 SELECT unnest(['main_table_discovery', 'period_accuracy', 'scope_accuracy', 'unit_accuracy', 'core_concept_recall', 'numeric_accuracy', 'false_verified_rate']) AS m, unnest([dr, pr, sr, ur, cr, nr, vf]) AS x, unnest([dn, n, n, n, cn, nn, vn]) AS y, unnest([NULL, pc, sc, uc, NULL, nc, NULL]) AS c FROM t, d)""")
def anchor_score(spark, d):
    part, year = F.col("l_partkey"), F.year("l_shipdate").cast("string")
    # dealt by key first: hardly a key repeats, and least texts are aggregated by sorting, which would hold a whole split of the file
    given = table(spark, d, "lineitem")
    own = given.repartition(tables.parts_for(spark, given.count()), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity")])
    lines = own.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("string").alias("table_id"), F.col("l_linenumber").alias("source_row"), F.col("l_suppkey").cast("string").alias("company_id"), F.col("l_linestatus").alias("scope"),
        F.lit("1").alias("unit_scale"), "l_returnflag", "l_partkey", "l_shipdate", F.col("l_quantity").cast("long").cast("string").alias("q"),
    )
    concept = F.concat(F.lit("c"), (part % 50).cast("string"))
    expected = lines.where("l_partkey % 10 <> 0").withColumns({"statement_type": F.col("l_returnflag"), "concept": F.when(part % 9 != 0, concept), "period": year, "currency": F.lit("CNY"), "value": F.when(part % 8 != 0, F.col("q"))})
    actual = lines.where("l_partkey % 13 <> 0").withColumns({
        "statement_type": F.when(part % 17 == 0, "X").otherwise(F.col("l_returnflag")), "concept": F.when(part % 11 == 0, "other").otherwise(concept), "period": F.when(part % 7 != 0, year), "currency": F.when(part % 6 == 0, "USD").otherwise("CNY"),
        "value": F.when(part % 19 == 0, "x").otherwise(F.concat("q", F.lit(".00"))), "verification_state": F.when(part % 4 == 0, "GAP").otherwise("VERIFIED"),
    })
    return tables.score(expected, actual, ["document_id", "table_id", "source_row"], ["document_id", "table_id"], 2 * given.count())


@query("""WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source AS company_id, CASE doc_id % 5 WHEN 0 THEN 'holdout' WHEN 1 THEN 'test' ELSE 'dev' END AS split, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS sha, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'real' END AS origin FROM documents)
 SELECT 'invalid:split' AS fault, document_id AS subject FROM m WHERE split = 'test' UNION ALL SELECT 'missing:origin', document_id FROM m WHERE origin = '' UNION ALL SELECT 'invalid:sha256', document_id FROM m WHERE sha = 'x'
 UNION ALL SELECT 'missing:sha256', document_id FROM m WHERE sha IS NULL UNION ALL SELECT 'missing:company_id', document_id FROM m WHERE company_id IS NULL
 UNION ALL SELECT 'duplicate:sha256', coalesce(sha, '') FROM m GROUP BY sha HAVING count(*) > 1 UNION ALL SELECT 'leaked', company_id FROM m GROUP BY company_id HAVING count(DISTINCT split) > 1""")
def manifest_faults(spark, d):
    key = F.col("doc_id")
    manifest = table(spark, d, "documents").select(
        key.cast("string").alias("document_id"), F.col("source").alias("company_id"), F.when(key % 5 == 0, "holdout").when(key % 5 == 1, "test").otherwise("dev").alias("split"), F.when(key % 11 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(key % 6 == 0, "").otherwise("real").alias("origin"), F.lit("c").alias("category"),
    )
    return tables.manifest_faults(manifest)


@query("""WITH p AS (SELECT event_id, user_id, ts, row_number() OVER w - count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 HOUR PRECEDING) AS place, lag(ts, 3) OVER w AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, CAST(place AS BIGINT) AS place, place <= 3 AS admitted, CAST(CASE WHEN place > 3 THEN greatest(0, ceil((epoch_us(back) + 3600000000 - epoch_us(ts)) / 1000000.0)) ELSE 0 END AS BIGINT) AS wait FROM p""")
def rate_admission(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return tables.admitted(events, ["user_id"], "ts", 3600, 3, "event_id").select("event_id", F.col("place").cast("long").alias("place"), "admitted", F.col("wait").cast("long").alias("wait"))


@query("""SELECT source AS company_id, count(DISTINCT doc_id % 3) AS splits, count(*) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1""")
def split_leakage(spark, d):
    return tables.split_leakage(table(spark, d, "documents").select(F.col("source").alias("company_id"), (F.col("doc_id") % 3).alias("split")))


# Scalars -----------------------------------------------------------------------

_TEXTS = [" 1,234.50 ", "（12.5）", "(3)", "-0.00", "1e3", "12,34", "1,234,", "—", "", "7%", "＋5", "0007.100", "-1,000"]


def _texts(spark, d):
    lines = table(spark, d, "lineitem").select(F.format_number("l_extendedprice", 2).alias("raw")).distinct()
    return lines.unionByName(spark.createDataFrame([(x,) for x in _TEXTS], "raw string"))


_RAW = "raw AS (SELECT DISTINCT format('{{:,.2f}}', l_extendedprice) AS raw FROM lineitem UNION ALL SELECT unnest([{}]))".format(", ".join(f"'{x}'" for x in _TEXTS))
_LOOSE = """, m AS (SELECT raw, translate(trim(raw), '，（）', ',()') AS t FROM raw),
 b AS (SELECT raw, t, starts_with(t, '(') AND ends_with(t, ')') AS w, regexp_replace(regexp_replace(t, '^\\((.*)\\)$', '\\1'), '[\\s,]', '', 'g') AS s FROM m)"""


@query("WITH " + _RAW + _LOOSE + """ SELECT raw, CAST(CASE WHEN regexp_full_match(regexp_replace(s, '^-', ''), '[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]{1,3})?')
 THEN CASE WHEN w OR starts_with(s, '-') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(s, '^-', '') AS DECIMAL(28,8)) END AS DOUBLE) AS value FROM b""")
def number_parse_loose(spark, d):
    return _texts(spark, d).select("raw", (N.loose_number(F.col("raw")).cast(DOUBLE) + F.lit(0.0)).alias("value"))


@query("WITH " + _RAW + _LOOSE + """, s2 AS (SELECT raw, w, regexp_replace(regexp_replace(t, '^\\((.*)\\)$', '\\1'), '\\s', '', 'g') AS s FROM b)
 SELECT raw, CAST(CASE WHEN regexp_full_match(s, '[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?') THEN CASE WHEN w THEN -1 ELSE 1 END * TRY_CAST(replace(s, ',', '') AS DECIMAL(28,8)) END AS DOUBLE) AS value,
 CASE WHEN regexp_full_match(s, '[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?') THEN CAST(length(regexp_extract(s, '\\.([0-9]*)$', 1)) AS INTEGER) END AS places FROM s2""")
def number_parse_strict(spark, d):
    return _texts(spark, d).select("raw", (N.strict_number(F.col("raw")).cast(DOUBLE) + F.lit(0.0)).alias("value"), N.decimal_places(F.col("raw")).alias("places"))


@query("""SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) / 10000.0 AS wan, CASE WHEN round(c_acctbal, 1) = 0 THEN '0.0' ELSE format('{:,.1f}', CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE)) END AS shown FROM customer""")
def format_half_up(spark, d):
    balance = F.col("c_acctbal").cast(facts.MONEY)
    return table(spark, d, "customer").select("c_custkey", N.convert_unit(balance, F.lit("元"), F.lit("万元")).cast(DOUBLE).alias("wan"), N.half_up(balance, 1).alias("shown"))


_LABELS = ["一、营业收入", "其中：利息费用", "减：营业成本（亏损以“-”号填列）", " 货币 资金 ", "1.应收账款", "(二)净利润(净亏损以负号填列)", "加：其他收益", "未知 科目"]


@example("""WITH l AS (SELECT unnest([{}]) AS label), c AS (SELECT label, regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(label, '\\s+', '', 'g'), '（）：', '():'),
 '^([一二三四五六七八九十]+、|[0-9]+[.．]|\\([一二三四五六七八九十0-9]+\\))', ''), '^(其中|加|减):', ''), '\\((净亏损|亏损|损失|亏损总额).*$', '') AS clean FROM l)
 SELECT label, clean, CASE clean WHEN '营业收入' THEN 'revenue' WHEN '营业成本' THEN 'cost' WHEN '货币资金' THEN 'cash' WHEN '应收账款' THEN 'accounts_receivable' WHEN '净利润' THEN 'net_profit' WHEN '其他收益' THEN 'other_income'
 ELSE 'disclosed_' || substr(sha256('income_statement:' || clean), 1, 32) END AS concept FROM c""".format(", ".join(f"'{x}'" for x in _LABELS)))
def label_normalise(spark, d):
    labels = spark.createDataFrame([(x,) for x in _LABELS], "label string")
    return labels.select("label", T.clean_label(F.col("label")).alias("clean"), T.concept_for(F.col("label"), F.lit("income_statement")).alias("concept"))


_CELLS = ["=1+1", "+5", "-3,000.5", "-x", "@home", "plain", " =A1", ""]


@query("""WITH c AS (SELECT unnest([{}]) AS cell UNION ALL SELECT DISTINCT p_name FROM part) SELECT cell, CASE WHEN regexp_matches(cell, '^\\s*[=+@-]') AND NOT regexp_full_match(cell, '-?[0-9][0-9,.]*') THEN chr(39) || cell ELSE cell END AS safe FROM c""".format(", ".join(f"'{x}'" for x in _CELLS)))
def csv_guard(spark, d):
    cells = spark.createDataFrame([(x,) for x in _CELLS], "cell string").unionByName(table(spark, d, "part").select(F.col("p_name").alias("cell")).distinct())
    return cells.select("cell", T.csv_guard(F.col("cell")).alias("safe"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 1 AS VARCHAR) AS day_before, CASE WHEN NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29) THEN CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS VARCHAR) END AS year_before,
 CAST(last_day(CAST(date_trunc('month', o_orderdate) - INTERVAL 3 MONTH AS DATE)) AS VARCHAR) AS quarter_before FROM orders""")
def period_offsets(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", P.day_before(day).cast("string").alias("day_before"), P.year_before(day).cast("string").alias("year_before"), P.quarter_end_before(day).cast("string").alias("quarter_before"))


@query("""WITH o AS (SELECT DISTINCT year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m FROM orders)
 SELECT raw, p.period, p.kind FROM (SELECT y || 'Q' || q AS raw, {'period': y || '-' || lpad(CAST(q * 3 - 2 AS VARCHAR), 2, '0') || '-01/' || last_day(make_date(y, q * 3, 1)), 'kind': 'quarter'} AS p FROM o
 UNION SELECT y || 'H1', {'period': y || '-01-01/' || y || '-06-30', 'kind': 'half_year'} FROM o UNION SELECT y || '年度', {'period': y || '-01-01/' || y || '-12-31', 'kind': 'year'} FROM o
 UNION SELECT y || '年1—' || m || '月', {'period': y || '-01-01/' || last_day(make_date(y, m, 1)), 'kind': CASE m WHEN 12 THEN 'year' WHEN 6 THEN 'half_year' WHEN 3 THEN 'quarter' ELSE 'duration' END} FROM o
 UNION SELECT y || '-01-01', {'period': (y - 1) || '-12-31', 'kind': 'instant'} FROM o UNION SELECT 'soon' || y, NULL FROM o)""")
def period_normalise(spark, d):
    y, q, m = (F.col(c).cast("string") for c in "yqm")
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m")).distinct()
    raw = F.array(F.concat(y, F.lit("Q"), q), F.concat(y, F.lit("H1")), F.concat(y, F.lit("年度")), F.concat(y, F.lit("年1—"), m, F.lit("月")), F.concat(y, F.lit("-01-01")), F.concat(F.lit("soon"), y))
    return o.select(F.explode(raw).alias("raw")).distinct().withColumn("p", P.normalize_period(F.col("raw"), F.lit("balance_sheet"))).select("raw", "p.period", "p.kind")


@query("""SELECT c_custkey, y || s AS param FROM (SELECT c_custkey, CAST(year(max(o_orderdate)) AS INTEGER) AS last, strftime(max(o_orderdate), '%Y%m%d') AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) c,
 LATERAL (SELECT unnest(range(last - 2, last + 1)) AS y), (SELECT unnest(['0331', '0630', '0930', '1231']) AS s) WHERE y || s <= top""")
def history_params_cross(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("top"))
    last = last.join(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    every = last.withColumn("y", F.explode(F.sequence(F.year("top") - 2, F.year("top")))).withColumn("s", F.explode(F.array(*map(F.lit, ["0331", "0630", "0930", "1231"]))))
    return every.select("c_custkey", F.concat(F.col("y").cast("string"), "s").alias("param"), F.date_format("top", "yyyyMMdd").alias("t")).where("param <= t").drop("t")


# JSON, HTML, documents -----------------------------------------------------------


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, CASE WHEN props IS NULL THEN 'empty_module' WHEN json_exists(props, '$.k') THEN 'ok' ELSE 'structure_changed' END AS state FROM events""")
def json_required_keys(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("long").alias("k"), F.coalesce(k.isNotNull(), F.lit(False)).alias("has_k"), F.when(F.col("props").isNull(), "empty_module").when(k.isNotNull(), "ok").otherwise("structure_changed").alias("state"))


@query("""SELECT page_id, CAST(unnest(range(1, len(h) + 1)) AS INTEGER) AS n, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1) AS h FROM pages)""")
def html_headings(spark, d):
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("n", "heading")).withColumn("n", F.col("n") + 1)


@query("""SELECT page_id, md5(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\\s*#+\\s*', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'))) AS text_md5 FROM pages""")
def html_text_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.plain(F.col("html"))).alias("text_md5"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents),
 n AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM l),
 p AS (SELECT doc_id, i, k, substr(x, k * 2000 + 1, 2000) AS part FROM (SELECT doc_id, i, x, unnest(range(0, greatest(CAST(ceil(length(x) / 2000.0) AS BIGINT), 1))) AS k FROM n)),
 q AS (SELECT doc_id, i, k, part, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i, k) AS reach FROM p),
 g AS (SELECT doc_id, list(i ORDER BY i, k) AS line, list(part ORDER BY i, k) AS parts, list_prepend(0, list(CAST(reach AS BIGINT) ORDER BY i, k)) AS reach FROM q GROUP BY 1),
 r AS (SELECT doc_id, 0 AS chunk, 0::BIGINT AS first, greatest(1, len(list_filter(reach, lambda x: x <= 2001)) - 1) AS stop FROM g UNION ALL
  SELECT doc_id, chunk, first, greatest(first + 1, len(list_filter(reach, lambda x: x <= reach[first + 1] + 2001)) - 1) FROM (
   SELECT g.doc_id, chunk + 1 AS chunk, reach, CASE WHEN len(list_filter(line, lambda x: x < line[stop] - 1)) > first THEN len(list_filter(line, lambda x: x < line[stop] - 1)) ELSE stop END AS first
   FROM r JOIN g ON g.doc_id = r.doc_id WHERE stop < len(line)))
 SELECT r.doc_id AS document_id, chunk, CAST(line[first + 1] AS INTEGER) AS start_line, CAST(line[stop] AS INTEGER) AS end_line, CAST(length(array_to_string(parts[first + 1:stop], chr(10))) AS INTEGER) AS chars, md5(array_to_string(parts[first + 1:stop], chr(10))) AS md5 FROM r JOIN g ON g.doc_id = r.doc_id""")
def text_chunk_overlap(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return documents.chunks(docs, 2000, 2).select("document_id", "chunk", "start_line", "end_line", F.length("text").alias("chars"), F.md5("text").alias("md5"))


@query(with_facts("""SELECT entity || '/' || scope || '/' || document_id AS module_key, key AS row_key, CAST("start" AS VARCHAR) AS period_raw, CAST(CASE key WHEN 'revenue' THEN revenue ELSE cost END AS DOUBLE) AS value, CAST(CASE key WHEN 'revenue' THEN revenue ELSE cost END AS DOUBLE) / 10000 AS amount
 FROM f, (SELECT unnest(['revenue', 'cost']) AS key)"""))
def module_amounts(spark, d):
    return module_values(spark, d).select("module_key", "row_key", "period_raw", F.col("value").cast(DOUBLE).alias("value"), F.col("amount").cast(DOUBLE).alias("amount"))


@query(with_facts("""SELECT entity || '/' || scope || '/' || document_id AS module_key, 'notes' AS category, 'O' AS currency, '1' AS rate, CASE key WHEN 'revenue' THEN 0 ELSE 1 END AS row_ordinal, key AS row_key, key AS name, '元' AS unit, 0 AS level,
 row_number() OVER (PARTITION BY entity, scope, document_id, key ORDER BY "start") - 1 AS period_ordinal, CAST("start" AS VARCHAR) AS period_raw, CAST(v AS VARCHAR) AS value, CAST(v * 0.0001 AS DECIMAL(38,17)) AS amount
 FROM (SELECT *, CAST(CASE key WHEN 'revenue' THEN revenue ELSE cost END AS DECIMAL(28,4)) AS v FROM f, (SELECT unnest(['revenue', 'cost']) AS key))"""))
def module_values(spark, d):
    f = facts.wide(spark, d).groupBy("entity", "scope", "document_id").agg(F.array_sort(F.collect_list(F.struct("start", "revenue", "cost"))).alias("x"))
    row = lambda key: F.struct(F.lit(key).alias("key"), F.lit(key).alias("name"), F.lit("元").alias("unit"), F.lit(0).alias("level"), F.transform("x", lambda v: v[key].cast("string")).alias("values"))
    payload = F.to_json(F.struct(F.concat_ws("/", "entity", "scope", "document_id").alias("module_key"), F.lit("notes").alias("category"), F.lit("O").alias("currency"), F.lit("1").alias("rate"), F.transform("x", lambda v: v["start"].cast("string")).alias("periods"), F.array(row("revenue"), row("cost")).alias("rows")))
    return modules.in_unit(modules.module_values(modules.currency_variant(modules.parsed_modules(f.select(payload.alias("payload"))))), "万元")


# Merging and packing -----------------------------------------------------------


@query("""SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS items, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS issues,
 min(l_linenumber) AS start_line, max(l_linenumber) AS end_line, count(*) AS fragments FROM lineitem GROUP BY 1""")
def fragment_merge(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_partkey").cast("string")).alias("items"), F.array("l_returnflag").alias("issues"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    out = merging.merged_fragments(lines, ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", F.array_join("items", ",").alias("items"), F.array_join(F.array_sort("issues"), ",").alias("issues"), "start_line", "end_line", "fragments")


@query("""WITH RECURSIVE l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 n AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, length(unnest(ls)) AS s FROM l),
 r AS (SELECT doc_id, i, s AS held, 1 AS batch FROM n WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN held + s > 1500 THEN s ELSE held + s END, CASE WHEN held + s > 1500 THEN batch + 1 ELSE batch END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
 SELECT doc_id, string_agg(last, ',' ORDER BY batch) AS ends FROM (SELECT doc_id, batch, max(i) AS last FROM r GROUP BY 1, 2) GROUP BY 1""")
def line_batches(spark, d):
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.length)
    return table(spark, d, "documents").select("doc_id", F.array_join(merging.batch_ends(sizes, 1500), ",").alias("ends"))


# Streams -------------------------------------------------------------------------


def _live(spark, d):
    return streams.event_stream(spark, f"{d}/event[s].parquet")  # a pattern, as a stream's path is a folder or a pattern


def _last(spark, stream, schema):
    """The complete result of a stream that was run to its end: each batch of it replaces the one before."""
    folder = streams.scratch(spark)
    streams.write_once(stream, f"{folder}/out", f"{folder}/log", "complete")
    out = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).drop("batch")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = _last(spark, streams.tumbling(_live(spark, d)), "window_start timestamp, event_type string, n long")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("""WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
 s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    out = _last(spark, streams.sessions(_live(spark, d)), "user_id long, session_start timestamp, session_end timestamp, n long")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("session_start"), stamp("session_end"), "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(spark, d):
    folder, twice = streams.scratch(spark), _live(spark, d).unionByName(_live(spark, d).where("event_id % 3 = 0"))
    streams.write_once(streams.deduplicated(twice).select("event_id", "user_id"), f"{folder}/out", f"{folder}/log")
    return spark.read.schema("event_id long, user_id long, batch int").parquet(f"{folder}/out").drop("batch")


@query("SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_live_tumbling(spark, d):
    out = _last(spark, streams.tumbling(_live(spark, d), "1 day"), "window_start timestamp, event_type string, n long")
    return out.select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_sink_once(spark, d):
    folder = streams.scratch(spark)
    streams.write_once(streams.deduplicated(_live(spark, d)).select("event_id", "user_id"), f"{folder}/out", f"{folder}/log")
    streams.write_once(streams.deduplicated(_live(spark, d)).select("event_id", "user_id"), f"{folder}/out", f"{folder}/log")  # the second run finds nothing new
    return spark.read.schema("event_id long, user_id long, batch int").parquet(f"{folder}/out").drop("batch")


_ACTIONS = {"view": "claim", "click": "heartbeat", "purchase": "complete", "signup": "fail"}


@query("""WITH RECURSIVE e AS (SELECT user_id AS task_id, event_id, epoch_us(ts) / 1000000.0 AS secs, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'fail' ELSE event_type END AS action,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r(task_id, n, event_id, state, attempts, lease) AS (SELECT DISTINCT task_id, 0::BIGINT, NULL::BIGINT, 'queued', 0, 0.0::DOUBLE FROM e UNION ALL
  SELECT e.task_id, e.n, e.event_id, CASE WHEN action = 'claim' AND (state = 'queued' OR (state = 'running' AND secs > lease)) THEN 'running' WHEN state = 'running' AND secs <= lease AND action = 'complete' THEN 'completed'
    WHEN state = 'running' AND secs <= lease AND action = 'fail' THEN CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END ELSE state END,
   attempts + CASE WHEN action = 'claim' AND (state = 'queued' OR (state = 'running' AND secs > lease)) THEN 1 ELSE 0 END,
   CASE WHEN (action = 'claim' AND (state = 'queued' OR (state = 'running' AND secs > lease))) OR (action = 'heartbeat' AND state = 'running' AND secs <= lease) THEN secs + 180 ELSE lease END
  FROM r JOIN e ON e.task_id = r.task_id AND e.n = r.n + 1)
 SELECT task_id, event_id, state, attempts FROM r WHERE n > 0""")
def stream_task_states(spark, d):
    action = F.coalesce(T.lookup(F.col("event_type"), _ACTIONS), F.col("event_type"))
    live = _live(spark, d).select(F.col("user_id").alias("task_id"), "event_id", "ts", action.alias("action"))
    folder = streams.scratch(spark)
    streams.write_once(streams.task_states(live), f"{folder}/out", f"{folder}/log")
    return spark.read.schema(f"{streams.TASK_OUT}, batch int").parquet(f"{folder}/out").drop("batch")
