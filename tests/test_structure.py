"""Tables that aren't well formed, outlines of notes, rows that were wrapped, headers of two rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brightledger.operators import documents, note_trees, notes, structure

KEYS = ["page"]


def events(spark, *bodies):
    return structure.tag_events(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page int, body string"), KEYS)


def cells(spark, body):
    found = structure.structured_cells(events(spark, body), KEYS).orderBy("table", "row", "col").collect()
    return [(r["table"], r["row"], r["col"], r["rowspan"], r["colspan"], r["is_header"], r["text"]) for r in found]


def issues(spark, body):
    return {(r["table"], r["issue"]): r["n"] for r in structure.structure_issues(events(spark, body), KEYS).collect()}


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<table><tr><th>a<td>b</table>", [(1, 1, 1, 1, 1, True, "a"), (1, 1, 2, 1, 1, False, "b")]),
        ("<table><td>a</td><tr><td>b</td></tr></table>", [(1, 1, 1, 1, 1, False, "a"), (1, 2, 1, 1, 1, False, "b")]),
        ("<TABLE><tr><td rowspan='2'>a</td><td>b</td></tr><tr></tr><tr><td>c</td></tr></table>", [(1, 1, 1, 2, 1, False, "a"), (1, 1, 2, 1, 1, False, "b"), (1, 3, 1, 1, 1, False, "c")]),
        ("<table><tr><td rowspan=2>a</td></tr><tr><td>b</td></tr></table>", [(1, 1, 1, 2, 1, False, "a"), (1, 2, 2, 1, 1, False, "b")]),
        ("<table><tr><td>a<table><tr><td>in</td></tr></table>b</td></tr></table>", [(1, 1, 1, 1, 1, False, "ab")]),
        ("<table><tr><td> x &amp;lt; &#20013;<br/>y <b>z</b></td></tr></table>out<table><tr><td>2</td></tr></table>", [(1, 1, 1, 1, 1, False, "x &lt; 中\ny z"), (2, 1, 1, 1, 1, False, "2")]),
        ("<!-- <table><td>no</td></table> --><script>'<table>'</script><table><tr><td title='a>b'>c</td></tr></table>", [(1, 1, 1, 1, 1, False, "c")]),
        ("</table></td><td>stray</td>", []),
        ("", []),
        (None, []),
    ],
)
def test_cells_of_any_markup(spark, body, expected):
    assert cells(spark, body) == expected


def test_every_deviation_is_an_issue_of_its_table(spark):
    assert issues(spark, "<table><tr><td>a</td></tr></table>") == {}
    assert issues(spark, "<table><td>a<td>b</td><tr><td>c</table>") == {(1, "cell_without_row"): 1, (1, "unclosed_cell"): 2}
    assert issues(spark, "<table><tr><td rowspan=0 colspan='x'>a</td><td colspan=1001>b</td></tr></table>") == {(1, "invalid_rowspan"): 1, (1, "invalid_colspan"): 2}
    assert issues(spark, "<table></table><table><tr><td>a<table></table>") == {(2, "nested_table"): 1, (2, "unclosed_cell"): 1, (2, "unclosed_table"): 1}


def test_spans_below_the_last_row_and_over_others(spark):
    found = structure.structured_cells(events(spark, "<table><tr><td>a</td><td rowspan=3>b</td></tr><tr><td colspan=2>c</td></tr></table>"), KEYS)
    assert [r["issues"] for r in documents.span_issues(found, KEYS).collect()] == [["rowspan_outside_table", "overlapping_cells"]]


def outline(spark, *titles):
    docs = spark.createDataFrame([("d", "\n".join(f"## {t}" for t in titles))], "document_id string, text string")
    return [(r["section"], r["scope"], r["categories"], r["header"], r["include"]) for r in notes.outline(docs).orderBy("line").collect()]


def test_a_section_of_a_scope_reigns_until_a_larger_number(spark):
    found = outline(spark, "七、合并财务报表项目注释", "二、联营企业", "七、其他", "八、合营", "三、附录", "1、存货")
    assert [f[0][0] for f in found] == ["七", "七", "七", "八", "三", "三"] and [f[1] for f in found] == ["consolidated"] * 3 + ["report"] * 3
    assert all(f[4] for f in found)


def test_topics_are_carried_to_the_headings_below(spark):
    found = outline(spark, "七、合并财务报表项目注释", "5、应收账款", "账龄", "(3) 存货明细", "6、其他", "账龄")
    assert [f[2] for f in found] == [[], ["应收账款"], ["应收账款"], ["应收账款", "存货"], [], []]
    assert [f[3] for f in found] == [True, True, True, True, True, False]


def test_a_part_ends_what_was_active(spark):
    found = outline(spark, "第十节 财务报告", "一、公司基本情况", "二、别的", "第十一节 其他", "一、再来", "一、审计报告")
    assert [f[4] for f in found] == [False, True, True, False, False, True]
    assert [f[0] for f in found] == ["第十节 财务报告", "一、公司基本情况", "二、别的", "第十一节 其他", "一、再来", "一、审计报告"]


def test_wrapped_rows_are_joined_as_far_as_they_continue(spark):
    rows = [["", "1", "2"], ["a", "509,352,8", "1."], ["", "17.", ""], ["", "46", "5"], ["b", "5", ""], ["", "7", ""], ["c", "30,000,514.4", "x"], ["", "6", "note"], ["d", "1,2", ""], ["", "", ""], ["", "34", ""]]
    found = notes.rejoined(spark.createDataFrame([(rows,), ([],)], "rows array<array<string>>")).collect()
    assert found[0]["rows"] == [["", "1", "2"], ["a", "509,352,8", "1."], ["", "17.", ""], ["", "46", "5"], ["b", "5", ""], ["", "7", ""], ["c", "30,000,514.46", "xnote"], ["d", "1,2", ""], ["", "", ""], ["", "34", ""]]
    assert found[1]["rows"] == []


def test_tables_that_differ_are_in_conflict(spark):
    table = lambda v: f"<table><tr><td>项目</td><td>期末余额</td></tr><tr><td>项目</td><td>账面价值</td></tr><tr><td>原材料</td><td>{v}</td></tr><tr><td>半成品</td><td>1</td></tr><tr><td>在产品</td><td>2</td></tr></table>"
    text = f"# 公司2025年年度报告\n## 七、合并财务报表项目注释\n### 9、存货\n单位：万元\n{table(3)}\n{table(4)}"
    docs = spark.createDataFrame([("d", text), ("n", None)], "document_id string, text string")
    found = note_trees.header_tree_matrix(docs, "存货").orderBy("place").select("key", F.col("value").cast("int"), "conflict", "candidates", F.col("period_end").cast("string")).collect()
    assert [tuple(r) for r in found] == [("原材料|账面价值", None, True, 2, "2025-12-31"), ("在产品及半成品|账面价值", 30000, False, 2, "2025-12-31")]


def test_the_last_unit_before_a_table_counts(spark):
    table = lambda v: f"<table><tr><td>项目</td><td>期末余额</td></tr><tr><td>原材料</td><td>{v}</td></tr></table>"
    text = f"# 公司2025年年度报告\n单位：千元\n## 存货\n单位：万元\n{table(1)}\n单位：元\n{table('10,000')}\n## 其他存货\n{table(10)}"
    found = documents.notes_matrix(spark.createDataFrame([("d", text)], "document_id string, text string"), "存货").collect()
    assert [(r["label"], int(r["value"]), r["conflict"], r["candidates"]) for r in found] == [("原材料", 10000, False, 3)]


def test_notes_and_their_tables_are_read_in_the_row_of_their_document(spark):
    docs = spark.createDataFrame([("d", "# 公司2024年年度报告\n## 七、合并财务报表项目注释\n### 1、货币资金\n单位：元\n<table><tr><td>项目</td></tr><tr><td>现金</td></tr></table>")], "document_id string, text string")
    found = notes.note_tables(docs)
    assert [(r["title"], r["cells"]) for r in found.collect()] == [("1、货币资金", ["现金"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_dense_rows_are_those_of_the_grid(spark):
    row = lambda *cells: "<tr>" + "".join(cells) + "</tr>"
    odd = [
        row("<td rowspan=9>a</td>", "<td>b</td>") + row("<td colspan='2'>c</td>") + row(), row("<td>a</td>", "<td rowspan=2>b</td>") + row("<td colspan=3>c</td>"),
        row("<td>a</td>") + row() + row("<td>b</td>", "<td>c</td>", "<td>d</td>") + row(), row(), row("<td>a</td>", "<td></td>") + row("<td></td>", "<td>x</td>") + "<tr><td>no end",
    ]
    body = "".join(f"<table>{t}</table>text" for t in odd)
    parts = spark.createDataFrame([("k", body), ("n", None), ("e", "")], "k string, body string")
    cells = {(r["table"], r["at_row"], r["at_col"]): r["text"] for r in documents.grid(documents.cells(documents.table_rows(parts, ["k"]), ["k"]), ["k"]).collect()}
    dense = {r["table"]: r["rows"] for r in documents.dense_rows(parts, ["k"]).collect()}
    size = lambda t, i: max(place[i] for place in cells if place[0] == t)
    assert dense == {t: [[cells.get((t, y + 1, x + 1), "") for x in range(size(t, 2))] for y in range(size(t, 1))] for t in {place[0] for place in cells}}
    assert set(dense) == {1, 2, 3, 5}


def test_lines_with_numbers_in_parentheses_are_those_of_the_sql(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb

    given = ["a (2) b", "a 2) b", "a (2 b", "x\na （2） b", "a 2， b", "a -2", "a 2.000000001", "a (7) b", "7)", "(7", "（7，", "7,0", "-7", "(-7)", "7.0)", None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("exact_source_line", "holds_number"):
        want = sorted(con.execute(entry.oracle_sql()[name]).fetchall())
        assert sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()) == want and len(want) > 4


def test_pipe_tables_are_read_in_the_row_of_their_document(spark):
    text = "x\n| a | b |\n|--|--|\n| `1 | 2` | 3\\|4 |\nc | d\n---|---\n5 | 6\n\n7 | 8\n| e |\n|-|"
    found = documents.pipe_rows(spark.createDataFrame([("d", text), ("n", None), ("p", "a | b")], "document_id string, text string"))
    assert [tuple(r)[1:] for r in found.orderBy("line").collect()] == [(2, 1, 2, ["a", "b"]), (2, 2, 4, ["`1 | 2`", "3|4"]), (5, 1, 5, ["c", "d"]), (5, 2, 7, ["5", "6"]), (10, 1, 10, ["e"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_cells_of_wrapped_rows_are_squeezed_once(spark):
    found = notes.rejoined(spark.createDataFrame([([["a", "1,2"], ["", "3 4"]],)], "rows array<array<string>>"))
    assert found.collect()[0]["rows"] == [["a", "1,23 4"]]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_texts_of_checked_cells_are_read_once(spark, sf):
    import __spark_entry__ as entry
    from brightledger.functions.numbers import strict_number

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(spark.createDataFrame([("(1,234.5)",)], "t string").select(strict_number(F.col("t")).alias("n"))).count("translate(") == 1
    lines = plan(entry.queries()["table_validation"](spark, sf)).splitlines()
    assert not [x for x in lines if "Filter" in x and "regexp_replace" in x]


def test_coverage_works_checked_cells_out_once(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["table_coverage"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.strip(" :+-|").startswith("Window") and "collect_set" in x for x in plan.splitlines()) == 1


def test_amounts_of_provider_statements_are_read_once(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["provider_statements"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate explode(array(" in x for x in plan.splitlines()) >= 1


def test_an_audit_shuffles_flags_of_cells_once_and_no_texts(spark):
    from brightledger.operators import audit

    block = "document_id string, block_id string"
    cell = lambda row, col, text, head=False: ("d", "b", row, col, head, text)
    given = [cell(1, 1, "项目", True), cell(1, 2, "2024", True), cell(1, 3, "12", True), cell(2, 1, "甲"), cell(2, 2, "5"), cell(2, 3, "x"), cell(3, 1, " "), cell(3, 2, "7"), cell(3, 3, "x"), cell(4, 1, "乙"), cell(4, 2, "8"), cell(4, 4, "9"), cell(5, 1, "丙"), cell(5, 4, "(1)")]
    cells = spark.createDataFrame(given, f"{block}, row int, col int, is_header boolean, text string")
    grid = cells.select("document_id", "block_id", F.col("row").alias("at_row"), F.col("col").alias("at_col"), "row", "col", "text")
    columns = spark.createDataFrame([("d", "b", 2, 1, [1]), ("d", "b", 3, 1, [1]), ("d", "b", 3, 2, [1])], f"{block}, column int, label_column int, header_rows array<int>")
    others = spark.createDataFrame([("d", "b", 1, True)], f"{block}, column int, valid boolean")
    claims = spark.createDataFrame([("d", "b", 2, "data", [(2,)]), ("d", "b", 4, "header", [(9,)]), ("d", "b", 9, "data", []), ("d", "z", 1, None, None)], f"{block}, row int, role string, values array<struct<column:int>>")
    found = audit.claim_audit(cells, grid, columns, others, claims)
    assert {r["issue"]: r["n"] for r in found.collect()} == {
        "foreign_model_row": 1, "model_row_out_of_bounds": 1, "model_cell_out_of_bounds": 1, "duplicate_metadata_column": 1, "label_column_is_value_column": 1,
        "unmapped_numeric_column": 1, "numeric_data_declared_header": 1, "unreadable_numeric_cell": 1, "unextracted_numeric_cells": 5,
    }
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("translate(") == 1  # each text is read once, before the shuffle
    assert not [line for line in text.splitlines() if "Join" in line and "row" in line]  # cells aren't paired by their rows


def test_a_module_is_parsed_once_and_its_columns_filtered_before_its_cells(spark, sf):
    import __spark_entry__ as entry
    from brightledger.operators import modules

    plan = entry.queries()["module_table"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "Join" not in plan

    body = lambda head, value: '{"data":{"head":%s,"key":%s,"value":%s}}' % (head, head, value)
    given = [("bare", body('["d"]', '[["20241231"]]')), ("two", body('["d","dataType","k"]', '[["20241231","合并期末","1.25"],["20231231","合并期末","--"],["20221231","母公司期末","3"]]')), ("broken", "x"), (None, body('["d","k"]', '[["20241231","7"]]'))]
    raw = spark.createDataFrame(given, "m string, payload string")
    cells = modules.provider_matrix(raw, ["m"])
    assert {(r["m"], r["row_ordinal"], r["period_ordinal"], r["key"], r["value"], r["state"]) for r in cells.where("m <> 'two' OR m IS NULL").collect()} == {("bare", None, 0, None, None, "ok"), ("broken", None, None, None, None, "structure_changed"), (None, 0, 0, "k", "7", "ok")}
    tables = [modules.module_table(x, ["m"], report="annual,latest", window_years=3, hide_empty=True, decimals=1) for x in (modules.matrix_columns(raw, ["m"]), cells.where("key IS NOT NULL OR state <> 'ok'"))]
    found = [sorted((str(r["m"]), r["key"], r["place"], r["shown"]) for r in t.collect()) for t in tables]
    assert found[0] == found[1] == [("None", "k", 1, "7.0"), ("two", "dataType", 1, "合并期末"), ("two", "dataType", 2, "合并期末"), ("two", "dataType", 3, "母公司期末"), ("two", "k", 1, "1.3"), ("two", "k", 2, "--"), ("two", "k", 3, "3.0")]


def test_supplements_are_read_in_the_row_of_their_document(spark):
    """No shuffle; headers, lines and years come out as they would of the tables one by one."""
    from brightledger.operators import supplements

    cell = lambda *cs: "<tr>" + "".join(f"<td>{c}</td>" for c in cs) + "</tr>"
    balance = "## 合并资产负债表\n单位：元\n<table>" + cell("项目", "期末余额", "期初余额") + cell("货币资金", "x", "5") + "</table>\n"
    summary = "<table>" + cell("主要会计数据", "2024 年", "2023年") + "\n" + cell("其他", "1", "2") + "\n" + cell("加权平均净资产收益率", "7%", "6%") + "</table>\n"
    spent = "## 七、合并财务报表项目注释\n<table>" + cell("补充资料", "本期金额", "上期金额") + cell("无形资产摊销", "(3)", "—") + "</table>"
    head = "# 甲公司2024年年度报告\n编制单位：甲\n"
    docs = spark.createDataFrame([("d", head + summary + balance + spent), ("two", head + summary + "".join(balance.replace("单位：元", f"编制单位：{x}\n单位：元") for x in "甲乙") + spent), ("none", summary + balance + spent), ("n", None)], "document_id string, text string")
    found = supplements.supplements(docs)
    # only the opening balance is a number, so that 2023 is the one known year
    assert sorted((r["document_id"], r["concept"], float(r["value"]), str(r["period_start"]), str(r["period_end"]), r["line"]) for r in found.collect()) == [
        ("d", "intangible_amortization", -3.0, "2024-01-01", "2024-12-31", 10), ("d", "reported_roe", 6.0, "2023-01-01", "2023-12-31", 5),
    ]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_long_line_before_a_statement_takes_no_square_of_its_length(spark):
    import time

    lead = lambda text: documents.sections(spark.createDataFrame([("d", text)], "document_id string, text string"), documents.PRIMARY).select("lead").collect()
    assert [r["lead"] for r in lead("a\n 单位：元 b \n\n \n## 合并资产负债表\n\n## 合并利润表\nx")] == [" 单位：元 b", ""]
    began = time.perf_counter()
    assert [r["lead"] for r in lead("数" * 150_000 + "\n单位：元\n## 合并资产负债表\nx")] == ["单位：元"]
    assert time.perf_counter() - began < 20
