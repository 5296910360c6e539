"""Matrices of notes with headers of two rows: inventories, and the main business by its dimensions.

A column stands for a period and a field, read from both header rows; a row that begins
with 分 opens a dimension for the rows below it. What one table says of a key under
several names is added up first; tables are held against each other afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import UNIT_SCALES, loose_number, unit_scale
from ..functions.periods import bound
from ..functions.text import lookup
from .documents import UNIT
from .notes import dense_tables, note_index

# Names of columns, of goods and of parts of the business, orders of what is shown.
CLOSING, OPENING, EARLIER = ["期末余额", "期末数", "期末账面余额", "本期发生额", "本期金额"], ["期初余额", "期初数", "上年年末余额"], ["上期发生额", "上期金额"]
GOODS = {"在产品": "在产品及半成品", "半成品": "在产品及半成品", "库存商品": "产成品及库存商品"}
SALES = {"营业收入合计": "营业收入", "境内销售": "国内", "境外销售": "国外"}
REVENUE, COST, WHOLE, BOOK, BALANCE, ALLOWANCE = "营业收入", "营业成本", "合计", "账面价值", "期末余额", "跌价准备"
DIMENSIONS = {"合计": 0, "产品": 1, "行业": 2, "地区": 3, "销售模式": 4}
INVENTORY, BUSINESS = "存货", "主营构成"


def column_end(name: Column, end: Column, business: bool) -> Column:
    """The day that a column is about, by its name in the first header row; null for a column of something else."""
    closing = CLOSING + (["本报告期", REVENUE, COST] if business else [])
    earlier = EARLIER + (["上年同期"] if business else [])
    found = F.when(name.isin(closing), end).when(name.isin(OPENING), F.make_date(F.year(end) - 1, F.lit(12), F.lit(31))).when(name.isin(earlier), F.add_months(end, -12))
    return F.coalesce(found, F.when(name.rlike("^20[0-9]{2}年$"), F.make_date(F.substring(name, 1, 4).cast("int"), F.lit(12), F.lit(31)))) if business else found


def header_columns(business: bool) -> Column:
    """The columns of amounts of a table (rows, deep, end), an array of (col, period_end, field)."""
    name = lambda c: F.get(F.get("rows", F.lit(0)), c)
    sub = lambda c: F.coalesce(F.when(F.col("deep") == 2, F.get(F.get("rows", F.lit(1)), c)), F.lit(""))

    def column(c: Column) -> Column:
        field = F.when(name(c).isin(REVENUE, COST), name(c)).otherwise(REVENUE) if business else sub(c)
        return F.struct(c.alias("col"), column_end(name(c), F.col("end"), business).alias("period_end"), field.alias("field"))

    def counts(c: Column) -> Column:
        known = ~sub(c).rlike("%|比例")
        return known & (((F.col("deep") == 2) & (sub(c) == "金额")) | ((F.col("deep") == 1) & name(c).isin(REVENUE, COST))) if business else known

    places = F.filter(F.sequence(F.lit(1), F.size(F.get("rows", F.lit(0))) - 1), counts)
    return F.filter(F.transform(places, column), lambda h: h["period_end"].isNotNull())


def keyed(cells: DataFrame, category: str, business: bool) -> DataFrame:
    """Cells (name, field, dimension) with key and label."""
    name, field = F.col("name"), F.col("field")
    if category == INVENTORY:
        goods, sub = F.coalesce(lookup(name, GOODS), name), F.when(field == BOOK, BOOK).when(field.contains("准备"), ALLOWANCE).otherwise(BALANCE)
        return cells.withColumn("key", F.concat_ws("|", goods, sub)).withColumn("label", F.when(goods == WHOLE, F.concat(sub, F.lit(WHOLE))).when(sub == BOOK, goods).otherwise(sub))
    if business:
        part = F.coalesce(lookup(name, SALES), name)
        part = F.when((part == REVENUE) & (field == COST), COST).otherwise(part)
        return cells.withColumn("key", F.concat_ws("|", field, "dimension", part)).withColumn("label", part)
    return cells.withColumn("key", F.concat_ws("|", name, field)).withColumn("label", F.when(field == "", name).otherwise(F.concat_ws(" · ", name, field)))


def header_tree_matrix(docs: DataFrame, category: str, scope: str = "consolidated") -> DataFrame:
    """Amounts of the notes of a category whose tables have headers of one or two rows.

    Returns document_id, place (of the row, from 1), key, label, section, period_end,
    value, conflict and candidates. Tables count whose first cell is 项目, 账龄 or 类别
    (项目 or nothing for the main business), with a money unit named before them; those
    of inventories need a column of book values. A cell without a readable amount is
    none. In a table amounts of one key are added; of several tables that differ the
    value is null and in conflict. Documents without a report period give no rows.
    """
    business = category == BUSINESS and scope == "consolidated"
    ids = ["document_id", "start_line"]
    mine = lambda note: note["report_end"].isNotNull() & F.array_contains(note["categories"], category)
    if business:
        notes = note_index(docs, lambda note: mine(note) & ~note["title"].contains("非主营"))
    else:
        notes = note_index(docs, lambda note: mine(note) & (note["scope"] == scope) & note["section"].contains("财务报表") & note["section"].contains("注释"))
    tables = dense_tables(notes.withColumnRenamed("report_end", "end").withColumn("body", F.col("text")), [*ids, "end", "text"])
    named = F.regexp_extract_all(F.array_join(F.slice(F.split("text", r"(?i)(?=<table\b)"), F.lit(1), F.col("table")), ""), F.lit(UNIT), F.lit(1))
    corner = F.get(F.get("rows", F.lit(0)), F.lit(0))
    deep = F.when(F.get(F.get("rows", F.lit(1)), F.lit(0)) == corner, 2).otherwise(1)
    tables = tables.withColumn("unit", F.get(named, F.size(named) - 1)).withColumn("deep", deep).where(corner.isin(["", "项目"] if business else ["项目", "账龄", "类别"]) & F.col("unit").isin(list(UNIT_SCALES)))
    tables = tables.withColumn("columns", header_columns(business))
    if category == INVENTORY:
        tables = tables.withColumn("columns", bound(F.col("columns"), lambda found: F.when(F.exists(found, lambda h: h["field"] == BOOK), found)))

    rows = tables.select(*ids, "table", "unit", "columns", "deep", F.posexplode("rows").alias("row", "cells")).where(F.col("row") >= F.col("deep")).withColumn("name", F.get("cells", F.lit(0))).where("name <> ''")
    opens = F.col("name").startswith("分") & F.lit(business)
    above = W.partitionBy(*ids, "table").orderBy("row")
    rows = rows.withColumn("opens", opens).withColumn("dimension", F.coalesce(F.last(F.when(F.col("opens"), F.substring("name", 2, 1000)), ignorenulls=True).over(above), F.lit(WHOLE))).where("NOT opens")
    cells = rows.select("*", F.inline("columns")).withColumn("amount", (loose_number(F.get("cells", F.col("col"))) * unit_scale(F.col("unit"))).cast("decimal(28,8)")).where("amount IS NOT NULL")
    own = keyed(cells, category, business).groupBy(*ids, "table", "key", "period_end").agg(F.sum("amount").alias("amount"), F.min(F.struct("row", "col", "label")).alias("first"))
    agreed = own.groupBy("document_id", "key", "period_end").agg(
        F.when(F.countDistinct("amount") == 1, F.min("amount")).alias("value"), (F.countDistinct("amount") > 1).alias("conflict"), F.count("amount").alias("candidates"), F.min(F.struct("start_line", "table", "first")).alias("seen")
    )

    part = F.split("key", r"\|")
    kept = agreed.withColumn("at", F.min("seen").over(W.partitionBy("document_id", "key")))
    if category == INVENTORY:
        goods = F.min("seen").over(W.partitionBy("document_id", part[0]))
        order = [goods, F.array_position(F.array(F.lit(BOOK), F.lit(BALANCE), F.lit(ALLOWANCE)), part[1])]
    elif category == BUSINESS:
        order = [F.when(part[0] == REVENUE, 0).otherwise(1), F.coalesce(lookup(part[1], {k: str(v) for k, v in DIMENSIONS.items()}).cast("int"), F.lit(len(DIMENSIONS))), F.col("at")]
    else:
        order = [F.col("at")]
    kept = kept.select("*", *[o.alias(f"o{i}") for i, o in enumerate(order)])
    place = F.dense_rank().over(W.partitionBy("document_id").orderBy(*[f"o{i}" for i in range(len(order))], "key"))
    section = F.when(F.lit(category == BUSINESS), F.concat_ws(" · ", part[0], part[1])).otherwise("")
    return kept.select("document_id", place.alias("place"), "key", F.col("at.first.label").alias("label"), section.alias("section"), "period_end", "value", "conflict", "candidates")
