"""Provider payloads written from orders, parsed and shown: matrices, trees, records, searches, statements, tables, trends.

A module is a customer; its columns, records or entries are the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modules as M
from ..sources import provider_modules
from ..sources.readers import table
from ..streaming.events import scratch
from .registry import query

DOUBLE = "double"

_ORDERS = """o AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderstatus AS s, o_orderpriority AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS v,
   CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS qe FROM orders),
 q AS (SELECT *, strftime(qe, '%Y%m%d') AS period, CASE s WHEN 'F' THEN '合并期末' WHEN 'O' THEN '母公司期末' ELSE '合并期末同比(%)' END AS kind, CASE p WHEN '1-URGENT' THEN '美元' ELSE '人民币' END AS currency FROM o)"""


def _orders(spark, d):
    quarter = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    kind = F.when(F.col("o_orderstatus") == "F", "合并期末").when(F.col("o_orderstatus") == "O", "母公司期末").otherwise("合并期末同比(%)")
    currency = F.when(F.col("o_orderpriority") == "1-URGENT", "美元").otherwise("人民币")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("module_key"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"), quarter.alias("qe"), F.date_format(quarter, "yyyyMMdd").alias("period"), kind.alias("kind"), currency.alias("currency"), F.year("o_orderdate").alias("y"),
    )


def _listed(*columns):
    """The orders of a module in order of their keys, a struct each."""
    return F.array_sort(F.collect_list(F.struct("o_orderkey", *columns)))


def _matrices(spark, d):
    """module_key and payload: a column of a matrix for each order."""
    words = lambda *names: F.array(*[F.lit(n) for n in names])
    cells = F.array("period", "kind", "currency", F.col("qe").cast("string"), F.col("v").cast("string"), (F.col("o_orderkey") % 100).cast("string"), F.lit("--"))
    own = _orders(spark, d).groupBy("module_key").agg(_listed(cells.alias("cells")).alias("rows"))
    data = F.struct(words("报告期", "类型", "币种", "截止", "货币资金", "其他资产(千元)", "空行").alias("head"), words("reportDate", "dataType", "displayCurrency", "deadline", "1", "2", "3").alias("key"), words(None, None, None, None, "元", "万元", "万元").cast("array<string>").alias("unit"),
                    F.transform("rows", lambda r: r["cells"]).alias("value"))
    return own.select("module_key", F.to_json(F.struct(data.alias("data")), {"ignoreNullFields": "false"}).alias("payload"))


def _cells(spark, d):
    return M.provider_matrix(_matrices(spark, d), ["module_key"])


@query("WITH " + _ORDERS + """ SELECT k AS module_key, unnest(['dataType', 'displayCurrency', 'deadline', '1', '2', '3']) AS key, place, period, unnest([kind, currency, CAST(qe AS VARCHAR), CAST(v AS VARCHAR), CAST(o_orderkey % 100 AS VARCHAR), '--']) AS value, 'ok' AS state FROM q""")
def provider_matrix(spark, d):
    return _cells(spark, d).select("module_key", "key", F.col("period_ordinal").cast("long").alias("place"), "period", "value", "state")


@query("WITH " + _ORDERS + """, f AS (SELECT *, CASE s WHEN 'F' THEN 'consolidated' ELSE 'parent' END AS scope, CASE currency WHEN '美元' THEN 'USD' ELSE 'CNY' END AS money FROM q WHERE s <> 'P')
 SELECT k AS module_key, place, scope, money AS currency, CAST(qe AS VARCHAR) AS period, unnest(['cash', 'unmapped', 'unmapped']) AS mapping, unnest(['元', '千元', '万元']) AS unit, unnest([CAST(v AS DOUBLE), (o_orderkey % 100) * 1000.0, NULL]) AS value,
 unnest(['0.01', '1', NULL]) AS step, unnest(['source_verified', 'source_verified', 'source_value_not_found']) AS status FROM f""")
def provider_statements(spark, d):
    headers = F.array(*map(F.lit, ["报告期", "类型", "币种", "截止", "货币资金", "其他资产(千元)", "空行"]))
    modules = table(spark, d, "orders").select(F.col("o_custkey").alias("module_key")).distinct().select(
        "module_key", F.lit("balance_sheet").alias("statement_type"), F.lit("甲").alias("entity"), F.lit("万元").alias("unit"), F.lit("1").alias("merge_range"), F.lit("O").alias("currency"), headers.alias("headers")
    )
    found = M.provider_statements(_cells(spark, d), modules, ["module_key"])
    return found.select("module_key", F.col("period_ordinal").cast("long").alias("place"), "scope", "currency", F.col("period_normalized").alias("period"), F.when(F.col("mapping_state") == "mapped", F.col("concept")).otherwise("unmapped").alias("mapping"),
                        F.col("raw_unit").alias("unit"), F.col("value").cast(DOUBLE).alias("value"), F.col("source_increment").alias("step"), "status")


@query("WITH " + _ORDERS + """, f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY qe DESC, place) AS n FROM q WHERE s = 'F' AND quarter(qe) IN (2, 4))
 SELECT k AS module_key, unnest(['1', '2']) AS key, year(qe) || CASE quarter(qe) WHEN 4 THEN '年年报' ELSE '年中报' END AS label, n AS place, unnest([CAST(CAST(v AS DECIMAL(38,1)) AS VARCHAR), CAST((o_orderkey % 100) * 10000 AS VARCHAR) || '.0']) AS shown FROM f""")
def module_table(spark, d):
    found = M.module_table(M.matrix_columns(_matrices(spark, d), ["module_key"]), ["module_key"], report="annual,half", scopes="合并期末", data_kinds="原始报表", hide_empty=True, unit="元", decimals=1)
    return found.where("key IN ('1', '2', '3')").select("module_key", "key", F.col("period_label").alias("label"), F.col("place").cast("long").alias("place"), "shown")


@query("WITH " + _ORDERS + " SELECT k AS module_key, period, CAST(min_by(v, place) FILTER (s = 'P') AS VARCHAR) AS growth FROM q GROUP BY 1, 2")
def statement_trend(spark, d):
    return M.statement_trend(_cells(spark, d), ["module_key"], "1", "balance_sheet", "合并期末").select("module_key", "period", F.col("同比").alias("growth"))


@query("WITH " + _ORDERS + """ SELECT k AS module_key, unnest(['a', 's', 'x']) AS key, unnest([0, 1, 2]) AS depth, unnest(['/1', '/1/0', '/1/0/0']) AS path, place, period, unnest([CAST(v AS VARCHAR), CASE WHEN s <> 'P' THEN s END, NULL]) AS value FROM q""")
def provider_analysis(spark, d):
    fields = '[{"value":"reportDate_x","name":"期"},{"value":"a","name":"金额","children":[{"value":"s","name":"状态","children":[{"key":"x","name":"无"}]}]}]'
    record = F.struct(F.col("period").alias("reportDate_x"), F.col("v").cast("string").alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    own = _orders(spark, d).groupBy("module_key").agg(_listed(record.alias("r")).alias("rows"))
    payload = F.concat(F.lit('{"data":{"fieldList":' + fields + ',"dataList":'), F.to_json(F.transform("rows", lambda x: x["r"])), F.lit("}}"))
    found = M.provider_analysis(own.select("module_key", payload.alias("payload")), ["module_key"])
    return found.select("module_key", "key", "depth", "path", F.col("period_ordinal").cast("long").alias("place"), "period", "value")


@query("""WITH o AS (SELECT o_custkey AS module_key, year(o_orderdate) AS y, CAST(o_orderkey AS VARCHAR) AS entry, o_orderstatus AS s, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS v, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS record FROM orders)
 SELECT module_key, record, y || '年年报' AS report, entry, unnest(['金额', '状态']) AS field, unnest([v, s]) AS value FROM o""")
def provider_records(spark, d):
    """A group of entries for each year of a customer's orders, behind the year's report."""
    blank = lambda c: F.concat(F.array(F.lit(None).cast("string")), F.transform("rows", lambda r: r[c]))
    years = _orders(spark, d).groupBy("module_key", "y").agg(_listed(F.col("o_orderkey").cast("string").alias("entry"), F.col("v").cast("string").alias("amount"), F.col("o_orderstatus").alias("state")).alias("rows"))
    parts = years.select("module_key", F.struct("y", F.concat(F.array(F.concat(F.col("y").cast("string"), F.lit("年年报"))), F.transform("rows", lambda r: r["entry"])).alias("head"), blank("amount").alias("amounts"), blank("state").alias("states")).alias("p"))
    whole = parts.groupBy("module_key").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    line = lambda name, c: F.concat(F.array(F.lit(name)), F.flatten(F.transform("ps", lambda p: p[c])))
    data = F.struct(line("指标", "head").alias("head"), F.array(line("金额", "amounts"), line("状态", "states")).alias("value"))
    found = M.provider_records(whole.select("module_key", F.to_json(F.struct(data.alias("data")), {"ignoreNullFields": "false"}).alias("payload")), ["module_key"])
    return found.select("module_key", F.col("record").cast("long").alias("record"), "report", "entry", "field", "value")


@query("SELECT c_nationkey AS module_key, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS code, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'structure_changed' ELSE 'ok' END AS state FROM customer")
def search_candidates(spark, d):
    entry = F.struct(F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"))
    found = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("module_key")).agg(F.collect_list(entry).alias("list"))
    raw = found.select("module_key", F.to_json(F.struct(F.struct("list").alias("data"))).alias("payload"))
    return M.search_candidates(raw, ["module_key"]).select("module_key", "code", "name", "state")


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'matrix' WHEN 2 THEN 'records' WHEN 3 THEN 'notes' WHEN 4 THEN 'records' ELSE 'empty' END AS kind FROM orders")
def view_kinds(spark, d):
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    variants = [
        join('{"metadata":{"unavailable":true},"periods":["', day, '"],"rows":[{"key":"', key, '"}]}'), join('{"periods":["', day, '"],"rows":[{"key":"', key, '"}]}'), join('{"head":[["a","', key, '"]],"rows":[[["1","2"]]]}'),
        join('{"category":"notes","head":["a","b"],"rows":[["', day, '","', key, '"]]}'), join('{"category":"notes","head":["a","b"],"rows":[["x', day, '","2"]]}'), join('{"head":[],"rows":[],"n":', key, "}"),
    ]
    payload = None
    for i, v in enumerate(variants):
        payload = (F if payload is None else payload).when(F.col("o_orderkey") % 6 == i, v)
    return table(spark, d, "orders").select("o_orderkey", M.view_kind(payload).alias("kind"))


@query("""SELECT n_name AS module_key, 'USD' AS currency, 'spot' AS rate, count(*) AS responses, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 WHERE n_regionkey < 3 AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1""")
def landed_modules(spark, d):
    """Responses are landed by module, currency and rate, and read back through the data source with filters that it takes over."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    owners = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    currency, rate = F.when(F.col("o_orderpriority") == "1-URGENT", "USD").otherwise("CNY"), F.when(F.col("o_orderstatus") == "F", "spot").otherwise("average")
    rows = table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("n_name").alias("module_key"), currency.alias("currency"), rate.alias("rate"), F.to_json(F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))).alias("payload"))
    folder = scratch(spark)
    provider_modules.land(rows, folder)
    wanted = [r["n_name"] for r in nations.where("n_regionkey < 3").collect()]  # of 25 nations
    found = provider_modules.landed_modules(spark, folder).where(F.col("module_key").isin(wanted) & (F.col("currency") == "USD") & (F.col("rate") == "spot"))
    total = F.sum(F.get_json_object("payload", "$.v").cast("decimal(18,2)")).cast(DOUBLE)
    return found.groupBy("module_key", "currency", "rate").agg(F.count(F.lit(1)).alias("responses"), total.alias("total"))
