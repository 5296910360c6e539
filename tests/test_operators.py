from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brightledger import schemas
from brightledger.functions import numbers
from brightledger.operators import checks, documents, matrix, metrics, modules, tables
from brightledger.operators.metric_catalogue import CATALOGUE
from brightledger.sources import readers, writers
from brightledger.streaming import events


def fact(concept, value, table="income_statement", start="2026-01-01", end="2026-06-30", kind="half_year", unit="元", status="source_verified", scope="consolidated", doc="d1", item=None, issues=()):
    day = lambda x: dt.date.fromisoformat(x) if x else None
    return (f"s{table}{end}", item or f"{concept}{end}{value}", doc, table, "甲公司", scope, "CNY", day(start), day(end), kind, "", concept, concept, "", unit, None if value is None else Decimal(value), status, "extracted", list(issues), True)


def balance(concept, value, end="2026-06-30", **how):
    return fact(concept, value, "balance_sheet", None, end, "instant", **how)


def cells(spark, rows, *codes):
    found = metrics.metric_cells(spark.createDataFrame(rows, schemas.STATEMENT_FACT), list(codes)).where("kind <> 'instant' AND end = DATE '2026-06-30'").collect()
    return {r["code"]: r for r in found}


def test_catalogue_has_119_metrics():
    assert len(CATALOGUE) == len({m.code for m in CATALOGUE}) == 119


def test_metric_values_offsets_and_reasons(spark):
    rows = [fact("revenue", "200"), fact("cost", "120"), fact("revenue", "160", start="2025-01-01", end="2025-06-30"), balance("inventory", "30"), balance("inventory", "10", "2025-12-31")]
    found = cells(spark, rows, "gross_margin", "revenue_growth", "inventory_turnover", "inventory_turnover_days", "net_margin", "quick_ratio")
    assert found["gross_margin"]["value"] == 40 and found["revenue_growth"]["value"] == 25 and found["inventory_turnover"]["value"] == 6
    assert found["inventory_turnover_days"]["value"] == 30
    assert found["net_margin"]["value"] is None and found["net_margin"]["reason"] == "缺少输入：净利润（2026-01-01/2026-06-30）"
    assert found["quick_ratio"]["reason"] == "缺少输入：流动资产合计（2026-06-30）" and found["quick_ratio"]["status"] == "unavailable"
    assert found["gross_margin"]["status"] == "pending_review" and len(found["gross_margin"]["inputs"]) == 2


def test_metric_guards_in_order(spark):
    zero, negative = [fact("revenue", "0"), fact("cost", "1")], [fact("revenue", "-5"), fact("cost", "1")]
    assert cells(spark, zero, "cost_rate")["cost_rate"]["reason"] == "分母为零"
    assert cells(spark, negative, "cost_rate")["cost_rate"]["reason"].startswith("分母为负")
    twice = [fact("revenue", "10"), fact("revenue", "11", item="other"), fact("cost", "1")]
    assert cells(spark, twice, "cost_rate")["cost_rate"]["reason"].startswith("同一科目存在冲突")
    same = [fact("revenue", "10"), fact("revenue", "10.0", item="other"), fact("cost", "1", status="human_confirmed")]
    assert cells(spark, same, "cost_rate")["cost_rate"]["value"] == 10
    blank = [fact("revenue", None), fact("cost", "1")]
    assert cells(spark, blank, "cost_rate")["cost_rate"]["reason"] == "来源数值尚未通过校验"
    unclear = [fact("revenue", "1", scope="unknown"), fact("cost", "1", scope="unknown")]
    assert cells(spark, unclear, "cost_rate")["cost_rate"]["reason"].startswith("主体")
    rejected = [fact("revenue", "10"), fact("revenue", "11", item="other", status="human_rejected"), fact("cost", "1")]
    assert cells(spark, rejected, "cost_rate")["cost_rate"]["value"] == 10
    unit = [fact("revenue", "10", unit="股"), fact("cost", "1")]
    assert cells(spark, unit, "cost_rate")["cost_rate"]["reason"] == "输入单位不一致"


def test_statement_checks(spark):
    row = lambda s, c, v, unit="元", step="1", status="source_verified": (s, "balance_sheet", c, v and Decimal(v), unit, step, status, "mapped")
    rows = [row("a", "total_assets", "100"), row("a", "total_liabilities", "60"), row("a", "total_equity", "39"), row("b", "total_assets", "100"), row("b", "total_liabilities", "60"), row("b", "total_equity", "30"),
            row("c", "total_assets", "100"), row("d", "total_assets", "9"), row("d", "total_assets", "9"), row("d", "total_liabilities", "5"), row("d", "total_equity", "4")]
    items = spark.createDataFrame(rows, "s string, statement_type string, concept string, value decimal(28,8), raw_unit string, source_increment string, status string, mapping_state string")
    found = {r["s"]: r for r in checks.statement_checks(items, ["s"]).where("code = 'assets_equal_liabilities_equity'").collect()}
    assert [found[s]["status"] for s in "abcd"] == ["passed", "conflict", "not_checked_missing_disclosure", "not_checked_unverified_source"]
    assert found["a"]["tolerance"] == Decimal("1.5") and found["c"]["missing_concepts"] == ["total_equity", "total_liabilities"]


def test_fact_ratios(spark):
    rows = [("p", c, v, "e", "s", "2026", "CNY", "元") for c, v in [("total_assets", "100"), ("total_liabilities", "80"), ("interest_bearing_debt", "30"), ("current_assets", "200"), ("current_liabilities", "100")]]
    facts = spark.createDataFrame(rows, "project string, concept string, value string, entity string, scope string, period string, currency string, unit string")
    found = {r["code"]: r for r in metrics.fact_ratios(facts).collect()}
    assert found["liabilities_to_assets"]["value"] == 0.8 and found["interest_bearing_debt_to_assets"]["value"] == 0.3
    assert found["quick_ratio"]["reason"] == "missing_required_input:inventory"
    again = {r["code"]: r for r in metrics.fact_ratios(facts.unionByName(facts.where("concept = 'total_assets'"))).collect()}
    assert again["liabilities_to_assets"]["status"] == "conflicted"


REPORT = """# 甲公司2026年半年度报告

编制单位：甲 公司
## 合并资产负债表
单位：万元
<table><tr><th>项目</th><th>期末余额</th><th>期初余额</th></tr>
<tr><td>货币资金</td><td>1,200.50</td><td>—</td></tr>
<tr><td>存货</td><td>(3)</td><td>0</td></tr></table>
```
## 合并利润表
```
## 母公司利润表
单位：元
<table><tr><td>项目</td><td>2026年半年度</td></tr><tr><td>一、营业收入</td><td>5</td></tr><tr><td>营业收入</td><td>6</td></tr><tr><td>基本每股收益</td><td>0.5</td></tr></table>
"""


def test_statement_facts(spark):
    docs = spark.createDataFrame([("d", REPORT)], "document_id string, text string")
    found = documents.statement_facts(docs).collect()
    key = {(r["statement_type"], r["concept"], str(r["period_end"]), r["raw_value"]): r for r in found}
    cash = key["balance_sheet", "cash", "2026-06-30", "1,200.50"]
    assert cash["value"] == Decimal("12005000") and cash["entity"] == "甲公司" and cash["start_line"] == 7
    assert key["balance_sheet", "inventory", "2025-12-31", "0"]["value"] == 0 and ("balance_sheet", "cash", "2025-12-31", "—") not in key
    assert key["income_statement", "revenue", "2026-06-30", "5"]["status"] == "pending_confirmation"
    assert sum(r["raw_unit"] == "元/股" for r in found) == 1 and len(found) == 6


def test_headings_tables_and_grid(spark):
    text = "# A\n## B\ntext\n# C\n### D\n<table><tr><th rowspan='2'>x</th><th colspan=2>y</th></tr><tr><td>1</td><td>2</td></tr></table>\n|a|b|\n|-|-|\n|1 \\| 2|3|\n"
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    stack = {r["title"]: (r["path"], r["line"]) for r in documents.heading_stack(docs).collect()}
    assert stack == {"A": (["A"], 1), "B": (["A", "B"], 2), "C": (["C"], 4), "D": (["C", "D"], 5)}
    rows = documents.table_rows(documents.sections(docs).where("title = 'D'"), ["document_id", "ordinal"])
    places = {(r["row"], r["col"], r["text"]) for r in documents.cells(rows, ["document_id", "ordinal"]).collect()}
    assert places == {(1, 1, "x"), (1, 2, "y"), (2, 2, "1"), (2, 3, "2")}
    dense = documents.grid(documents.cells(rows, ["document_id", "ordinal"]), ["document_id", "ordinal"])
    assert {(r["at_row"], r["at_col"], r["text"]) for r in dense.collect()} == {(1, 1, "x"), (2, 1, "x"), (1, 2, "y"), (1, 3, "y"), (2, 2, "1"), (2, 3, "2")}
    assert [r["cells"] for r in documents.pipe_rows(docs).orderBy("row").collect()] == [["a", "b"], ["1 | 2", "3"]]


def test_chunks_cover_all_lines(spark):
    lines = [f"line {i} " + "x" * (i % 40) for i in range(200)] + ["y" * 500]
    docs = spark.createDataFrame([("d", "\n".join(lines))], "document_id string, text string")
    found = documents.chunks(docs, 200, 2).orderBy("chunk").collect()
    assert all(len(r["text"]) <= 200 for r in found) and found[0]["start_line"] == 1 and found[-1]["end_line"] == 201
    assert all(b["start_line"] <= a["end_line"] + 1 for a, b in zip(found, found[1:]))
    with pytest.raises(ValueError):
        documents.chunks(docs, 10)


def test_notes_matrix(spark):
    text = REPORT + "## 七、合并财务报表项目注释\n### 1、货币资金\n单位：元\n<table><tr><td>项目</td><td>期末余额</td><td>期初余额</td><td>比例(%)</td></tr><tr><td>库存现金</td><td>10</td><td></td><td>5</td></tr><tr><td>银行存款</td><td>7</td><td>8</td><td>2</td></tr></table>\n### 2、货币资金\n<table><tr><td>项目</td><td>期末余额</td></tr><tr><td>银行存款</td><td>9</td></tr></table>"
    docs = spark.createDataFrame([("d", text)], "document_id string, text string")
    found = {(r["label"], str(r["period_end"])): (r["value"], r["conflict"]) for r in documents.notes_matrix(docs, "货币资金").collect()}
    assert found["库存现金", "2026-06-30"] == (10, False) and ("库存现金", "2025-12-31") not in found
    assert found["银行存款", "2025-12-31"] == (8, False) and found["银行存款", "2026-06-30"] == (None, True)


def test_modules(spark):
    good = '{"module_key":"m","category":"notes","currency":"O","rate":"1","periods":["2025","2026"],"rows":[{"key":"a","name":"A","unit":"元","level":0,"values":["10000","x"]},{"key":"dataType","name":"t","unit":null,"level":0,"values":["","同比(%)"]}]}'
    raw = spark.createDataFrame([(1, good), (2, good.replace('["10000","x"]', '["1"]')), (3, "{}"), (4, "nonsense")], "id int, payload string")
    parsed = modules.parsed_modules(raw)
    assert {r["id"]: r["state"] for r in parsed.collect()} == {1: "ok", 2: "structure_changed", 3: "structure_changed", 4: "structure_changed"}
    found = modules.in_unit(modules.module_values(modules.currency_variant(parsed)), "万元").orderBy("period_ordinal").collect()
    assert [(r["period_raw"], r["value"], r["amount"]) for r in found] == [("2025", "10000", 1.0), ("2026", "x", None)]


def test_matrix_options(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 31), 1), (dt.date(2026, 6, 30), 2), (dt.date(2026, 3, 31), 3)], "end date, v int")
    assert {r["v"] for r in matrix.report_filter(df, "end", "latest,annual").collect()} == {1, 2}
    assert {r["v"] for r in matrix.report_filter(df, "end", "quarter").collect()} == {3}
    with pytest.raises(ValueError):
        matrix.report_filter(df, "end", "weekly")
    with pytest.raises(ValueError):
        matrix.rolling_years(df, "end", [], 4)


def test_cell_states(spark):
    rows = [("a", "source_verified", 1), ("b", "human_rejected", 1), ("c", "source_value_not_found", None), ("d", "source_verified", 1), ("d", "source_verified", 2), ("e", "human_confirmed", 5), ("f", None, None)]
    found = {r["k"]: (r["state"], r["value"]) for r in tables.cell_state(spark.createDataFrame(rows, "k string, status string, value int"), ["k"]).collect()}
    assert found == {"a": ("pending", 1), "b": ("rejected", None), "c": ("unverified", None), "d": ("conflict", None), "e": ("value", 5), "f": ("empty", None)}


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "=1"), ("b", None)], "k string, v string")
    writers.write_csv(df, str(tmp_path / "c"))
    written = b"".join(f.read_bytes() for f in sorted((tmp_path / "c").glob("part-*")) if f.stat().st_size)
    assert written.count(b"\xef\xbb\xbf\"k\",\"v\"\r\n") >= 1 and b"\"a\",\"'=1\"\r\n" in written and b"\"b\",\"\"\r\n" in written
    writers.publish(df.limit(1), str(tmp_path / "pub"), "t")
    writers.publish(df, str(tmp_path / "pub"), "t")
    assert writers.published(spark, str(tmp_path / "pub"), "t").count() == 2 and '"name":"k"' in writers.schema_json({"t": "k string"})["t"]
    assert writers.append_once(df, str(tmp_path / "p"), "k") == 2 and writers.append_once(df, str(tmp_path / "p"), "k") == 0
    new = spark.createDataFrame([("a", "2")], "k string, v string")
    assert {(r["k"], r["v"]) for r in writers.upserted(df, new, ["k"]).collect()} == {("a", "2"), ("b", None)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.md").write_text("﻿hello\nworld", encoding="utf-8")
    assert readers.text_documents(spark, str(tmp_path / "t")).first()["text"] == "hello\nworld"


def test_streams_agree_with_batches(spark, sf):
    batch = readers.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    live = lambda: events.event_stream(spark, f"{sf}/event[s].parquet")
    assert events.run_to_end(events.deduplicated(live()), "append").count() == batch.select("event_id").distinct().count()
    ended = events.run_to_end(events.tumbling(live()), "complete")
    assert ended.exceptAll(events.tumbling(batch)).count() == 0 and ended.count() == events.tumbling(batch).count()


def test_import_faults(spark):
    docs = spark.createDataFrame([("d", "a\nassets 5")], "document_id string, text string")
    sha = docs.select(F.sha2("text", 256)).first()[0]
    facts = spark.createDataFrame([("d", sha, 1, 2, "assets 5"), ("d", sha, 1, 1, "assets 5")], "document_id string, sha256 string, expected_revision int, line int, quote string")
    proven = readers.proven_facts(facts, docs)
    assert {(r["line"], r["proven"]) for r in proven.collect()} == {(2, True), (1, False)}
    revisions = spark.createDataFrame([("d", 2)], "document_id string, revision int")
    assert {r["fault"] for r in readers.import_faults(proven, revisions).collect()} == {"stale_revision", "unproven_fact"}


def test_score_rejects_repeated_anchors_and_counts_all_expected(spark):
    columns = "document_id string, table_id string, row int, company_id string, statement_type string, concept string, period string, scope string, currency string, unit_scale string, value string, verification_state string"
    cell = lambda row, period, value, state="VERIFIED": ("d", "t", row, "c", "bs", "cash", period, "parent", "CNY", "1", value, state)
    expected = spark.createDataFrame([cell(1, "2025", "1"), cell(2, "2025", "2")], columns)
    actual = spark.createDataFrame([cell(1, "2025", "1.0"), cell(2, "2024", "2"), cell(3, "2025", "9")], columns)
    found = {r["metric"]: r for r in tables.score(expected, actual, ["document_id", "table_id", "row"], ["document_id", "table_id"]).collect()}
    assert (found["period_accuracy"]["numerator"], found["period_accuracy"]["denominator"], found["period_accuracy"]["coverage_numerator"]) == (1, 2, 2)
    assert (found["false_verified_rate"]["numerator"], found["false_verified_rate"]["denominator"]) == (2, 3) and found["numeric_accuracy"]["value"] == 0.5
    with pytest.raises(ValueError):
        tables.score(expected, actual.unionByName(actual), ["document_id", "table_id", "row"], ["document_id", "table_id"])


def test_conversion_is_exact(spark):
    row = spark.createDataFrame([("123456789012345678.125",)], "v string").select(
        numbers.convert_unit(F.col("v").cast("decimal(28,8)"), F.lit("%"), F.lit("万元")).alias("same"), numbers.convert_unit(F.lit("1.23456789").cast("decimal(28,8)"), F.lit("元"), F.lit("十亿元")).alias("small")
    ).first()
    assert row["same"] == Decimal("123456789012345678.125") and row["small"] == Decimal("0.00000000123456789")


def test_flattening_keeps_every_level(spark):
    schema = "struct<key:string,name:string>"
    for _ in range(5):
        schema = f"struct<key:string,name:string,children:array<{schema}>>"
    node = ("f", "f")
    for name in "edcba":
        node = (name, name, [node])
    nested = spark.createDataFrame([(1, [node])], f"id int, children array<{schema}>")
    assert [(r["key"], r["depth"]) for r in modules.flattened(nested, ["id"]).orderBy("depth").collect()] == [(k, i) for i, k in enumerate("abcdef")]


def test_statements_are_found_in_the_row_of_their_document(spark):
    docs = spark.createDataFrame([("d", "# 公司2024年年度报告\n编制单位：甲\n## 合并资产负债表\n单位：元\n<table><tr><td>项目</td><td>期末余额</td></tr><tr><td>货币资金</td><td>5</td></tr></table>"), ("n", None)], "document_id string, text string")
    found = documents.statement_facts(docs)
    assert [(r["concept"], r["raw_value"], r["start_line"]) for r in found.collect()] == [("cash", "5", 5)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_only_headings_are_shuffled_to_be_numbered(spark):
    docs = spark.createDataFrame([("d", "# A\ntext\n\nB\n---\n---\n```\n# no\n```")], "document_id string, text string")
    found = documents.headings(docs)
    assert [(r["level"], r["title"], r["line"]) for r in found.orderBy("line").collect()] == [(1, "A", 1), (2, "B", 4)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan or plan.rindex("Filter") > plan.rindex("Exchange")


def test_score_deals_rows_into_parts_by_their_number(spark, monkeypatch):
    import re

    columns = "document_id string, table_id string, row int, company_id string, statement_type string, concept string, period string, scope string, currency string, unit_scale string, value string, verification_state string"
    side = spark.createDataFrame([(None if i == 3 else "d", "t", i, "c", "bs", "cash", "2025", "parent", "CNY", "1", "1", "VERIFIED") for i in range(40)], columns)
    monkeypatch.setattr(tables, "ROWS_OF_A_PART", 10)
    found = tables.score(side, side, ["document_id", "table_id", "row"], ["document_id", "table_id"])
    assert {r["metric"]: r["numerator"] for r in found.collect()}["numeric_accuracy"] == 40  # null anchors match, too
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) == {"9"}
