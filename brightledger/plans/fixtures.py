"""Fixed documents and payloads that exercise what the tables have nothing of: statements, notes, provider modules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def html(*rows: list) -> str:
    """An HTML table; a cell may be a pair of its attributes and its text."""
    cell = lambda c: f"<td {c[0]}>{c[1]}</td>" if isinstance(c, tuple) else f"<td>{c}</td>"
    return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


STATEMENTS = "\n".join([
    "# 乙公司2026年半年度报告", "编制单位：乙 公司", "单位：万元", "## 合并资产负债表",
    html(["项目", "期末余额", "期初余额"], ["流动资产：", "", ""], ["货币资金", "1,200.50", "—"], ["存货", "(3)", "0"], ["非流动资产：", "", ""], ["固定资产", "8", "7.5"]),
    "```", "## 合并利润表", "```", "## 母公司利润表", "单位：元", html(["项目", "2026年半年度"], ["一、营业收入", "5"], ["营业收入", "6"], ["基本每股收益", "0.5"]),
])

OUTLINE = "\n".join(["Report", "======", "intro", "# One ##", "####### seven", "#hashtag", "~~~", "# not this", "~~~", "Sub", "---", "text", "", "more", "## Two", "| a | b |", "|---|---|", "| 1 | 2 |", "", "<table><tr><td>x</td></tr></table>", "tail"])

NOTES = "\n".join([
    "# 丙公司2025年年度报告", "## 第六节 重要事项", "### 四、聘任、解聘会计师事务所情况", html(["境内会计师事务所报酬（万元）", "120"]),
    "## 第十节 财务报告", "## 一、审计报告", html(["审计意见类型", "标准的无保留意见"], ["审计报告签署日期", "2026年03月30日"], ["审计机构名称", "某会计师事务所（特殊普通合伙）"]),
    "### 三、管理层的责任", "## 二、财务报表", "## 七、合并财务报表项目注释", "### 二、联营企业", "### 1、货币资金", "单位：万元",
    html(["项目", "期末余额", "期初余额"], ["库存现金", "1.5", "2"], ["银行存款", "10", "9"], ["受限", "4", "4"], ["合计", "11.5", "11"]),
    "### 5、应收账款", "单位：元",
    html(["账龄", ("colspan=2", "期末余额"), "期初余额"], ["账龄", "账面余额", "比例(%)", "账面余额"], ["1年以内（含1年）", "100.00", "50", "90"], ["1至2年", "509,352,8", "", ""], ["", "17.46", "", ""], ["合计", "5,093,628,17.46", "", "x"]),
    "(2) 按欠款方归集的期末余额前五名的应收账款", "#### (3) 按欠款方归集的前五名的应收账款情况", "单位：元", html(["单位名称", "应收账款期末余额", "占应收账款比例(%)"], ["甲", "70", "35.0"], ["乙", "30.0", "15"], ["小计", "100", "50"]),
    "### 60、财务费用", "单位：元", html(["项目", "本期发生额", "上期发生额"], ["利息费用", "12", "11"], ["减：利息收入", "3", "(4)"], ["租赁负债利息费用", "1", "1"], ["手续费", "0.5", ""]),
    "## 十七、母公司财务报表主要项目注释", "### 1、应收账款", "单位：元", html(["账龄", "期末余额"], ["1年以内", "7"], ["合计", "7"]),
    "## 二十、补充资料", "### 1、当期非经常性损益明细表", "单位：元", html(["项目", "金额"], ["计入当期损益的政府补助", "8"], ["所得税影响额", "2"], ["少数股东权益影响额（税后）", "1"]),
])


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("statements", STATEMENTS), ("outline", OUTLINE), ("notes", NOTES), ("empty", ""), ("none", None)], "document_id string, text string")


def _matrix() -> str:
    keys = [("reportDate", "报告期", None), ("dataType", "类型", None), ("displayCurrency", "币种", None), ("deadline", "截止", None), ("1", "货币资金", "万元"), ("2", "其他资产(万元)", None), ("3", "空行", "万元")]
    columns = [["20251231", "合并期末", "人民币", "2025-12-31", "1,234.5", "8", "--"], ["20251231", "合并期末同比(%)", "人民币", "2025-12-31", "10.5", "3", ""], ["20250930", "合并期末", "美元", "2025-09-30", "1e3", "-", ""], ["20241231", "母公司期末", "人民币", "2024-12-31", "7", "x", None], ["20200331", "合并期末", "人民币", "2020-03-31", "0", "0", "-"]]
    return json.dumps({"data": {"head": [n for _, n, _ in keys], "key": [k for k, _, _ in keys], "unit": [u for _, _, u in keys], "value": columns}}, ensure_ascii=False)


def _analysis() -> str:
    deep = {"value": "f", "name": "六", "children": []}
    for i, name in enumerate("五四三二"):
        deep = {"value": "edcb"[i], "name": name, "children": [deep]}
    fields = [{"value": "reportDate_x", "name": "期"}, {"value": "a", "name": "一", "children": [deep]}, {"value": "z", "name": "末"}]
    records = [{"reportDate_x": "20251231", "a": "1", "f": "6", "z": None}, {"reportDate_x": "20241231", "a": "2", "c": "3"}]
    return json.dumps({"data": {"fieldList": fields, "dataList": records}}, ensure_ascii=False)


def _records() -> str:
    head = ["指标", "2025年年报", "甲", "乙", "2025年中报", "丙"]
    return json.dumps({"data": {"head": head, "value": [["金额", None, "1", "2", None, "3"], ["比例", None, "4", None, None, "6"]]}}, ensure_ascii=False)


def payloads(spark: SparkSession) -> DataFrame:
    """module_key and payload of a matrix, an analysis, records, a search, and three that are broken."""
    search = json.dumps({"data": {"list": [{"code": "A1", "name": "甲"}, {"code": "", "name": "乙"}]}}, ensure_ascii=False)
    rows = [("matrix", _matrix()), ("analysis", _analysis()), ("records", _records()), ("search", search), ("short", '{"data":{"head":["a","b"],"key":["a","b"],"value":[["1"]]}}'), ("bare", '{"data":{"head":["a","b"],"key":["a","b"],"value":[]}}'), ("broken", "x")]
    return spark.createDataFrame(rows, "module_key string, payload string")
