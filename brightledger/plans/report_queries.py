"""Annual reports written from the orders of each customer, and read back: statements, layout, notes, records, audit.

The SQL works out from the orders what a reader must find; it never sees a report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import note_trees, notes, supplements, validation
from ..sources.readers import table
from .registry import query

DOUBLE = "double"


def _table(*rows):
    """An HTML table of cells that are texts or columns."""
    cell = lambda c: F.lit(c) if isinstance(c, str) else c
    parts = [F.lit("<table>")]
    for row in rows:
        parts.append(F.lit("<tr>"))
        for c in row:
            parts += [F.lit("<td>"), cell(c), F.lit("</td>")]
        parts.append(F.lit("</tr>"))
    return F.concat(*parts, F.lit("</table>"))


def reports(spark, d):
    """document_id and text: a report for each customer with orders, of the year of the last one."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    some = lambda test: F.sum(F.when(test, amount))
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.year(F.max("o_orderdate")).alias("y"), F.sum(amount).alias("c1"), some(F.col("o_orderstatus") == "F").alias("c0"), some(F.col("o_orderpriority") == "1-URGENT").alias("i1"),
        F.count(F.lit(1)).cast("string").alias("i0"), some(F.col("o_orderstatus") == "O").alias("r1"),
    )
    own = orders.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    shown = lambda c, blank: F.coalesce(F.format_number(c, 2), F.lit(blank))
    signed = F.concat((F.col("y") + 21).cast("string"), F.lit("年03月"), F.lpad((F.col("o_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("日"))
    texts = own.select(
        "o_custkey", "c_name", (F.col("y") + 20).cast("string").alias("y"), shown("c1", "").alias("c1"), shown("c0", "—").alias("c0"), "i0", F.coalesce(F.concat(F.lit("("), F.format_number("i1", 2), F.lit(")")), F.lit("")).alias("i1"),
        shown("r1", "不适用").alias("r1"), signed.alias("signed"),
    )
    y, c1, c0, i0, i1, r1, signed = (F.col(c) for c in ("y", "c1", "c0", "i0", "i1", "r1", "signed"))
    lines = [
        F.concat(F.lit("# "), "c_name", F.lit("公司"), y, F.lit("年年度报告")), F.concat(F.lit("编制单位："), "c_name", F.lit(" 公司")), F.lit("单位：元"), F.lit("## 合并资产负债表"),
        _table(["项目", "期末余额", "期初余额"], ["流动资产：", "", ""], ["货币资金", c1, c0], ["存货", i1, i0]),
        F.lit("## 母公司利润表"), F.lit("单位：元"), _table(["项目", F.concat(y, F.lit("年度"))], ["一、营业收入", r1]),
        F.lit("## 第十节 财务报告"), F.lit("## 一、审计报告"), _table(["审计意见类型", "标准的无保留意见"], ["审计报告签署日期", signed]), F.lit("## 二、财务报表"),
        F.lit("## 七、合并财务报表项目注释"), F.lit("### 1、货币资金"), F.lit("单位：万元"), _table(["项目", "期末余额", "期初余额"], ["库存现金", c1, c0], ["合计", c1, i0]),
        F.lit("### 5、应收账款"), F.lit("单位：元"), _table(["账龄", "期末余额", "期初余额"], ["1年以内（含1年）", c1, i0], ["1至2年", c0, ""], ["合计", c1, "x"]),
        F.lit("#### (3) 前五名的应收账款情况"), F.lit("单位：元"), _table(["单位名称", "应收账款期末余额", "占应收账款比例(%)"], [F.col("c_name"), c1, "62.5"], ["小计", c1, "62.5"]),
        F.lit("### 60、财务费用"), F.lit("单位：元"), _table(["项目", "本期发生额", "上期发生额"], ["利息费用", c1, c0], ["减：利息收入", i0, ""]),
        F.lit("## 十七、母公司财务报表主要项目注释"), F.lit("### 1、应收账款"), F.lit("单位：元"), _table(["账龄", "期末余额"], ["1年以内", i0], ["合计", c1]),
        F.lit("## 二十、补充资料"), F.lit("### 1、当期非经常性损益明细表"), F.lit("单位：元"), _table(["项目", "金额"], ["计入当期损益的政府补助", c1], ["所得税影响额", i0]),
    ]
    return texts.select(F.col("o_custkey").cast("string").alias("document_id"), F.concat_ws("\n", *lines).alias("text"))


_BASE = """a AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
 g AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, o_custkey AS k, any_value(c_name) AS name, year(max(o_orderdate)) + 20 AS y, sum(v) AS c1, sum(v) FILTER (o_orderstatus = 'F') AS c0, sum(v) FILTER (o_orderpriority = '1-URGENT') AS i1,
   count(*) AS i0, sum(v) FILTER (o_orderstatus = 'O') AS r1 FROM a JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"""


def _rows(columns: str, *selects: str) -> str:
    return f"WITH {_BASE} SELECT {columns} FROM ({' UNION ALL '.join(selects)})"


def _constant(columns: str, values: str) -> str:
    return f"WITH {_BASE} SELECT document_id, v.* FROM g CROSS JOIN (VALUES {values}) AS v({columns})"


def _amounts(*parts: tuple[str, str, str]) -> str:
    """Rows (document_id, label, period, value, conflict) of labels, years and amounts, without missing ones."""
    each = [f"SELECT document_id, '{label}' AS label, (y - {back}) || '-12-31' AS period, CAST({value} AS DOUBLE) AS value FROM g" for label, back, value in parts]
    return _rows("document_id, label, period, value, false AS conflict", *each) + " WHERE value IS NOT NULL"


@query(_rows("document_id, statement_type, scope, concept, value, period, 'source_verified' AS status",
    "SELECT document_id, 'balance_sheet' AS statement_type, 'consolidated' AS scope, 'cash' AS concept, CAST(c1 AS DOUBLE) AS value, y || '-12-31' AS period FROM g", "SELECT document_id, 'balance_sheet', 'consolidated', 'cash', c0, (y - 1) || '-12-31' FROM g",
    "SELECT document_id, 'balance_sheet', 'consolidated', 'inventory', -i1, y || '-12-31' FROM g", "SELECT document_id, 'balance_sheet', 'consolidated', 'inventory', i0, (y - 1) || '-12-31' FROM g",
    "SELECT document_id, 'income_statement', 'parent', 'revenue', r1, y || '-12-31' FROM g") + " WHERE value IS NOT NULL")
def statement_extract(spark, d):
    found = D.statement_facts(reports(spark, d))
    return found.select("document_id", "statement_type", "scope", "concept", F.col("value").cast(DOUBLE).alias("value"), F.col("period_end").cast("string").alias("period"), "status")


@query(_constant("n, section, label, line", "(1, '资产负债表', '项目', 5), (2, '流动资产', '流动资产', 5), (3, '流动资产', '货币资金', 5), (4, '流动资产', '存货', 5), (5, '利润表', '项目', 8), (6, '利润表', '营业收入', 8)"))
def source_layout(spark, d):
    return D.source_layout(reports(spark, d)).select("document_id", F.col("source_order").alias("n"), F.col("source_section").alias("section"), F.col("source_label").alias("label"), F.col("start_line").alias("line"))


@query(f"""WITH {_BASE} SELECT document_id, level, CASE WHEN title = '' THEN name || '公司' || y || '年年度报告' ELSE title END AS title, line FROM g CROSS JOIN (VALUES (1, '', 1), (2, '合并资产负债表', 4), (2, '母公司利润表', 6), (2, '第十节 财务报告', 9), (2, '一、审计报告', 10),
 (2, '二、财务报表', 12), (2, '七、合并财务报表项目注释', 13), (3, '1、货币资金', 14), (3, '5、应收账款', 17), (4, '(3) 前五名的应收账款情况', 20), (3, '60、财务费用', 23), (2, '十七、母公司财务报表主要项目注释', 26), (3, '1、应收账款', 27), (2, '二十、补充资料', 30), (3, '1、当期非经常性损益明细表', 31)) AS v(level, title, line)""")
def heading_levels(spark, d):
    return D.headings(reports(spark, d)).select("document_id", "level", "title", "line")


@query(_constant("title, scope, categories, first, last", "('一、审计报告', 'report', '审计报告', 10, 11), ('七、合并财务报表项目注释', 'consolidated', '', 13, 13), ('1、货币资金', 'consolidated', '货币资金', 14, 16), ('5、应收账款', 'consolidated', '应收账款', 17, 19), ('(3) 前五名的应收账款情况', 'consolidated', '应收账款', 20, 22), ('60、财务费用', 'consolidated', '财务费用', 23, 25), ('十七、母公司财务报表主要项目注释', 'parent', '', 26, 26), ('1、应收账款', 'parent', '应收账款', 27, 29), ('二十、补充资料', 'report', '', 30, 30), ('1、当期非经常性损益明细表', 'report', '非经常性损益', 31, 33)"))
def note_index(spark, d):
    return notes.note_index(reports(spark, d)).select("document_id", "title", "scope", F.array_join("categories", ",").alias("categories"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))


@query(f"""WITH {_BASE}, t AS (SELECT document_id, '<table><tr><td>项目</td><td>期末余额</td><td>期初余额</td></tr><tr><td>库存现金</td><td>' || format('{{:,.2f}}', CAST(c1 AS DOUBLE)) || '</td><td>' || coalesce(format('{{:,.2f}}', CAST(c0 AS DOUBLE)), '—')
   || '</td></tr><tr><td>合计</td><td>' || format('{{:,.2f}}', CAST(c1 AS DOUBLE)) || '</td><td>' || i0 || '</td></tr></table>' AS body FROM g)
 SELECT document_id, 0 AS ordinal, 'text' AS kind, '1、货币资金 单位：万元' AS text FROM t UNION ALL SELECT document_id, 1, 'table', body FROM t""")
def note_blocks(spark, d):
    found = notes.note_blocks(notes.note_index(reports(spark, d)).where("title = '1、货币资金'"), ["document_id"])
    return found.select("document_id", "ordinal", "kind", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _matrix(spark, d, category, scope="consolidated"):
    found = notes.specialised_matrix(reports(spark, d), category, scope)
    return found.select("document_id", "label", F.col("period_end").cast("string").alias("period"), F.col("value").cast(DOUBLE).alias("value"), "conflict")


@query(_amounts(("现金", 0, "c1 * 10000"), ("现金", 1, "c0 * 10000"), ("合计", 0, "c1 * 10000"), ("合计", 1, "i0 * 10000")))
def notes_matrix_cash(spark, d):
    return _matrix(spark, d, "货币资金")


@query(_amounts(("1年内", 0, "c1"), ("1年内", 1, "i0"), ("1-2年", 0, "c0"), ("合计", 0, "c1")))
def notes_matrix_ageing(spark, d):
    return _matrix(spark, d, "应收账款账龄分析")


@query(_amounts(("1年内", 0, "i0"), ("合计", 0, "c1")))
def notes_matrix_parent(spark, d):
    return _matrix(spark, d, "应收账款账龄分析", "parent")


@query(_amounts(("利息支出", 0, "c1"), ("利息支出", 1, "c0"), ("减：利息收入", 0, "-i0")))
def notes_matrix_costs(spark, d):
    return _matrix(spark, d, "财务费用")


@query(_amounts(("政府补助", 0, "c1"), ("所得税影响数", 0, "-i0")))
def notes_matrix_nonrecurring(spark, d):
    return _matrix(spark, d, "非经常性损益")


@query(_rows("document_id, label, value, false AS conflict", "SELECT document_id, '库存现金' AS label, y AS period, CAST(c1 * 10000 AS DOUBLE) AS value FROM g", "SELECT document_id, '库存现金', y - 1, c0 * 10000 FROM g",
    "SELECT document_id, '合计', y, c1 * 10000 FROM g", "SELECT document_id, '合计', y - 1, i0 * 10000 FROM g") + " WHERE value IS NOT NULL")
def notes_matrix_generic(spark, d):
    return D.notes_matrix(reports(spark, d), "货币资金").select("document_id", "label", F.col("value").cast(DOUBLE).alias("value"), "conflict")


@query(_rows("document_id, period, name, amount, other, false AS conflict", "SELECT document_id, y || '-12-31' AS period, name, CAST(c1 AS VARCHAR) AS amount, '62.5' AS other FROM g", "SELECT document_id, y || '-12-31', '合计', CAST(c1 AS VARCHAR), '62.5' FROM g"))
def note_records(spark, d):
    found = notes.records_table(reports(spark, d), "前五名应收账款", "consolidated")
    return found.select("document_id", F.col("period_end").cast("string").alias("period"), "name", "amount", "other", "conflict")


@query(_rows("document_id, label, period, value, false AS conflict", "SELECT document_id, '审计意见' AS label, y || '-12-31' AS period, '标准无保留' AS value FROM g", "SELECT document_id, '审计日期', y || '-12-31', (y + 1) || '-03-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') FROM g",
    "SELECT document_id, '审计报告正文', y || '-12-31', '查看' FROM g"))
def audit_matrix(spark, d):
    return notes.audit_matrix(reports(spark, d)).select("document_id", "label", F.col("period_end").cast("string").alias("period"), "value", "conflict")


@query(f"""WITH {_BASE} SELECT document_id, n, n = 1 AS proven FROM g CROSS JOIN (VALUES (1), (2), (3)) AS v(n)""")
def evidence_proof(spark, d):
    """Quotes of the preparer's line: as it stands, of another line, and of another customer."""
    docs = reports(spark, d)
    quote = F.get(F.split("text", "\n"), 1)
    spans = docs.select("document_id", F.lit("b").alias("block_id"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"))
    variant = lambda n, line, said: F.struct(F.lit(n).alias("n"), F.lit(line).alias("line"), said.alias("quote"))
    variants = F.array(variant(1, 2, quote), variant(2, 3, quote), variant(3, 2, F.concat(quote, F.lit("甲"))))
    quotes = docs.select("document_id", F.lit("b").alias("block_id"), F.inline(variants)).select("document_id", "block_id", "n", F.col("line").alias("start_line"), F.col("line").alias("end_line"), "quote")
    return validation.proven(quotes, docs, spans).select("document_id", "n", "proven")


@query(_constant("n, kind, first, last, path", """(1, 'heading', 1, 1, ''), (2, 'text', 2, 3, ''), (3, 'heading', 4, 4, '合并资产负债表'), (4, 'table', 5, 5, '合并资产负债表'), (5, 'heading', 6, 6, '母公司利润表'), (6, 'text', 7, 7, '母公司利润表'), (7, 'table', 8, 8, '母公司利润表')"""))
def document_map(spark, d):
    """The blocks of a report as far as its two statements, in order; paths below the title."""
    found = D.document_map(reports(spark, d)).where("end_line <= 8")
    return found.select("document_id", (F.col("ordinal") + 1).alias("n"), "kind", F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.array_join(F.slice("path", 2, 9), "/").alias("path"))


# Headers of two rows -------------------------------------------------------------


def _trees(spark, d):
    """document_id and text: a report for each customer with notes on inventories and on the main business, sums by priority."""
    amount, kinds = F.col("o_totalprice").cast("decimal(18,2)"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    own = table(spark, d, "orders").groupBy("o_custkey").agg((F.year(F.max("o_orderdate")) + 20).cast("string").alias("y"), F.sum(amount).alias("t"), *[F.sum(F.when(F.col("o_orderpriority") == k, amount)).alias(f"p{i + 1}") for i, k in enumerate(kinds)])
    s = {c: F.col(c) for c in ["t", "p1", "p2", "p3", "p4", "p5"]}
    own = own.select("o_custkey", "y", *[F.coalesce(F.format_number(c, 2), F.lit("")).alias(c) for c in s])
    body = lambda name, a, b="", c="": [name, a, b, a, c, "", c]
    goods = _table(body("原材料", s["p1"], "3.5", s["p2"]), body("在产品", s["p3"]), body("半成品", s["p4"]), body("库存商品", s["p5"]), body("合计", s["t"]))
    heads = '<table><tr><td rowspan="2">项目</td><td colspan="3">期末余额</td><td colspan="3">期初余额</td></tr><tr>' + "<td>账面余额</td><td>跌价准备</td><td>账面价值</td>" * 2 + "</tr>"
    sales = _table(["营业收入合计", s["t"], "100", s["p1"], "5"], ["分行业", "", "", "", ""], ["制造业", s["p2"], "1", s["p3"], "1"], ["分地区", "", "", "", ""], ["境内销售", s["p4"], "2", "", ""], ["国内", "1", "2", "", ""])
    business = '<table><tr><td rowspan="2"></td><td colspan="2">本报告期</td><td colspan="2">上年同期</td></tr><tr>' + "<td>金额</td><td>占比(%)</td>" * 2 + "</tr>"
    inner = lambda head, rows: F.concat(F.lit(head), F.substring(rows, len("<table>") + 1, 1_000_000))
    lines = [F.concat(F.lit("# 公司"), "y", F.lit("年年度报告")), F.lit("## 七、合并财务报表项目注释"), F.lit("### 9、存货"), F.lit("单位：千元"), F.lit("单位：元"), inner(heads, goods), F.lit("### 61、营业收入和营业成本"), F.lit("单位：万元"), inner(business, sales)]
    return own.select(F.col("o_custkey").cast("string").alias("document_id"), F.concat_ws("\n", *lines).alias("text"))


_KINDS = """a AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders),
 g AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, year(max(o_orderdate)) + 20 AS y, sum(v) AS t, sum(v) FILTER (o_orderpriority = '1-URGENT') AS p1, sum(v) FILTER (o_orderpriority = '2-HIGH') AS p2, sum(v) FILTER (o_orderpriority = '3-MEDIUM') AS p3,
   sum(v) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS p4, sum(v) FILTER (o_orderpriority = '5-LOW') AS p5 FROM a GROUP BY o_custkey)"""


def _placed(rows: list[tuple[str, str, int, str]]) -> str:
    """Rows of (key, label, years back, amount) in their order; places count the keys that a document has."""
    each = [f"SELECT document_id, {n} AS o, '{key}' AS key, '{label}' AS label, (y - {back}) || '-12-31' AS period, CAST({value} AS DOUBLE) AS value FROM g" for n, (key, label, back, value) in enumerate(rows)]
    return f"""WITH {_KINDS}, r AS (SELECT * FROM ({' UNION ALL '.join(each)}) WHERE value IS NOT NULL), k AS (SELECT *, min(o) OVER (PARTITION BY document_id, key) AS first FROM r)
 SELECT document_id, dense_rank() OVER (PARTITION BY document_id ORDER BY first) AS place, key, label, period, value, false AS conflict FROM k"""


def _tree(spark, d, category):
    found = note_trees.header_tree_matrix(_trees(spark, d), category)
    return found.select("document_id", F.col("place").cast("long").alias("place"), "key", "label", F.col("period_end").cast("string").alias("period"), F.col("value").cast(DOUBLE).alias("value"), "conflict")


_HALF = "CASE WHEN p3 IS NULL THEN p4 WHEN p4 IS NULL THEN p3 ELSE p3 + p4 END"


@query(_placed([("原材料|账面价值", "原材料", 0, "p1"), ("原材料|账面价值", "原材料", 1, "p2"), ("原材料|期末余额", "期末余额", 0, "p1"), ("原材料|期末余额", "期末余额", 1, "p2"), ("原材料|跌价准备", "跌价准备", 0, "3.5"),
    ("在产品及半成品|账面价值", "在产品及半成品", 0, _HALF), ("在产品及半成品|期末余额", "期末余额", 0, _HALF), ("产成品及库存商品|账面价值", "产成品及库存商品", 0, "p5"), ("产成品及库存商品|期末余额", "期末余额", 0, "p5"), ("合计|账面价值", "账面价值合计", 0, "t"), ("合计|期末余额", "期末余额合计", 0, "t")]))
def inventory_matrix(spark, d):
    return _tree(spark, d, "存货")


@query(_placed([("营业收入|合计|营业收入", "营业收入", 0, "t * 10000"), ("营业收入|合计|营业收入", "营业收入", 1, "p1 * 10000"), ("营业收入|行业|制造业", "制造业", 0, "p2 * 10000"), ("营业收入|行业|制造业", "制造业", 1, "p3 * 10000"), ("营业收入|地区|国内", "国内", 0, "(coalesce(p4, 0) + 1) * 10000")]))
def business_matrix(spark, d):
    return _tree(spark, d, "主营构成")


# Supplements ---------------------------------------------------------------------


def _summaries(spark, d):
    """document_id and text: a report for each customer with summary tables before its balance sheet, and depreciation in its notes."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    own = table(spark, d, "orders").groupBy("o_custkey").agg((F.year(F.max("o_orderdate")) + 20).alias("y"), F.sum(amount).alias("c1"), F.sum(F.when(F.col("o_orderstatus") == "F", amount)).alias("c0"), F.count(F.lit(1)).cast("string").alias("n"))
    y, c1, c0 = F.col("y").cast("string"), F.format_number("c1", 2), F.coalesce(F.format_number("c0", 2), F.lit("不适用"))
    lines = [
        F.concat(F.lit("# 甲公司"), y, F.lit("年年度报告")), F.lit("编制单位：甲公司"), F.lit("## 第二节 主要财务指标"),
        _table(["主要会计数据", F.concat(y, F.lit(" 年")), F.concat((F.col("y") - 1).cast("string"), F.lit("年")), F.concat((F.col("y") - 9).cast("string"), F.lit("年"))], ["归属于上市公司股东的扣除非经常性损益的净利润（元）", c1, c0, "1"], ["加权平均净资产收益率", F.concat("n", F.lit("%")), "—", "1%"], ["其他", c1, c0, "1"]),
        _table(["报告期利润", "加权平均净资产收益率", "基本每股收益", "稀释每股收益"], ["扣除非经常性损益后归属于公司普通股股东的净利润", F.concat("n", F.lit(".5%")), "0.25", "-"]),
        _table(["", "本次变动前", "比例", "增减", "本次变动后", "比例"], ["三、股份总数", "1,000", "100%", "5", F.col("n"), "100%"]), F.lit("## 合并资产负债表"), F.lit("单位：元"), _table(["项目", "期末余额", "期初余额"], ["货币资金", c1, "1"]),
        F.lit("## 七、合并财务报表项目注释"), F.lit("### 79、现金流量表补充资料"), _table(["补充资料", "本期金额", "上期金额"], ["使用权资产折旧", c1, c0], ["净利润", "1", "2"]), _table(["主要会计数据", y], ["加权平均净资产收益率", "9"]),
    ]
    return own.select(F.col("o_custkey").cast("string").alias("document_id"), F.concat_ws("\n", *lines).alias("text"))


def _supplement_sql() -> str:
    span = lambda back: f"(y - {back}) || '-01-01/' || (y - {back}) || '-12-31'"
    rows = [("net_profit_excluding_nonrecurring", "c1", span(0), 4), ("net_profit_excluding_nonrecurring", "c0", span(1), 4), ("reported_roe", "i0", span(0), 4), ("reported_ex_roe", "i0 + 0.5", span(0), 5), ("reported_ex_basic_eps", "0.25", span(0), 5),
            ("ordinary_share_count", "i0", "y || '-12-31'", 6), ("ordinary_share_count", "1000", "(y - 1) || '-12-31'", 6), ("rou_depreciation", "c1", span(0), 12), ("rou_depreciation", "c0", span(1), 12)]
    each = [f"SELECT document_id, '{c}' AS concept, CAST({v} AS DOUBLE) AS value, {p} AS period, {line} AS line FROM g" for c, v, p, line in rows]
    return _rows("document_id, concept, value, period, line", *each) + " WHERE value IS NOT NULL"


@query(_supplement_sql())
def supplement_facts(spark, d):
    found = supplements.supplements(_summaries(spark, d))
    period = F.concat_ws("/", F.col("period_start").cast("string"), F.col("period_end").cast("string"))
    return found.select("document_id", "concept", F.col("value").cast(DOUBLE).alias("value"), period.alias("period"), "line")
