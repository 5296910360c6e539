"""Provider modules: JSON payloads to long values, variants, views and trends."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.numbers import UNIT_SCALES, convert_unit, exponent_increment, loose_number, unit_scale
from ..functions.periods import bound, quarter_index, report_kind, report_order
from ..functions.text import ALIASES, clean_label, is_blank_export, lookup
from ..schemas import MODULE
from .matrix import REPORTS, WINDOWS, scope_and_kind

#: Rows of a module that describe its columns and are no facts. Fixed values.
METADATA_ROWS = ["dataType", "deadline", "displayCurrency", "originalCurrency", "conversionRate", "rateType", "declareDate", "dataSource"]


def parsed_modules(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads (JSON text) as modules, with ``state``: ok, structure_changed or empty_module.

    A payload whose rows aren't as long as its periods has changed its structure.
    """
    m = F.from_json(column, MODULE)
    even = F.forall("m.rows", lambda r: F.coalesce(F.size(r["values"]) == F.size(F.col("m.periods")), F.lit(False)))
    state = F.when(F.col("m.module_key").isNull() | F.col("m.periods").isNull() | F.col("m.rows").isNull(), "structure_changed").when(F.size("m.rows") == 0, "empty_module").when(~even, "structure_changed").otherwise("ok")
    return raw.withColumn("m", m).select(*[c for c in raw.columns if c != column], "m.*", state.alias("state"))


def module_values(modules: DataFrame, keep_metadata: bool = False) -> DataFrame:
    """Long form: one row for each module, row and period. Values are joined to periods by position."""
    rows = modules.where("state = 'ok'").select("module_key", "category", "currency", "rate", "periods", F.posexplode("rows").alias("row_ordinal", "r"))
    if not keep_metadata:
        rows = rows.where(~F.col("r.key").isin(METADATA_ROWS))
    cells = F.posexplode(F.arrays_zip(F.col("periods").alias("period"), F.col("r.values").alias("value")))
    return rows.select("module_key", "category", "currency", "rate", "row_ordinal", F.col("r.key").alias("row_key"), F.col("r.name").alias("name"), F.col("r.unit").alias("unit"), F.col("r.level").alias("level"), cells.alias("period_ordinal", "c")).select(
        "module_key", "category", "currency", "rate", "row_ordinal", "row_key", "name", "unit", "level", "period_ordinal", F.col("c.period").alias("period_raw"), F.col("c.value").alias("value")
    )


def currency_variant(modules: DataFrame, currency: str = "O", rate: str = "1") -> DataFrame:
    """The variant of a currency and rate; there is no other one to fall back on. A module that offers it twice in readable form is an error when it is read."""
    own = modules.where((F.col("currency") == currency) & (F.col("rate") == rate))
    twice = F.count_if(F.col("state") == "ok").over(W.partitionBy("module_key")) > 1
    return own.withColumn("_ok", F.when(twice, F.raise_error(F.concat(F.lit("ambiguous_variant: "), "module_key"))).otherwise(F.lit(True))).where("_ok").drop("_ok")


def monetary(values: DataFrame, data_type: str) -> DataFrame:
    """Without the percentage columns, which never are amounts."""
    return values.where(~F.coalesce(F.col(data_type).rlike("[%％]"), F.lit(False)))


def in_unit(values: DataFrame, target: str) -> DataFrame:
    """Numeric values in another money unit; text and other units as they are."""
    number = F.col("value").try_cast("decimal(28,8)")
    return values.withColumn("amount", convert_unit(number, F.col("unit"), F.lit(target)))


def flattened(nested: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of a tree (struct<key,name,children>, as deep as its type) with depth and path, parents first."""
    level = nested.select(*ids, F.posexplode("children").alias("_o", "node"))
    level = level.select(*ids, "node", F.lit(0).alias("depth"), F.col("node.key").alias("path"), F.array("_o").alias("order"))
    out = None
    while True:
        kept = level.select(*ids, F.col("node.key").alias("key"), F.col("node.name").alias("name"), "depth", "path", "order")
        out = kept if out is None else out.unionByName(kept)
        if "children" not in level.schema["node"].dataType.names:
            return out
        level = level.select(*ids, "path", "order", "depth", F.posexplode("node.children").alias("_o", "child")).select(
            *ids, F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "child.key").alias("path"), F.concat("order", F.array("_o")).alias("order")
        )


@F.pandas_udf(ArrayType(StructType().add("key", "string").add("name", "string").add("depth", "integer").add("path", "string")))
def tree_rows(trees: pd.Series) -> pd.Series:
    """Nodes of a JSON tree (a list of objects with value or key, name and children) of any depth, parents first; null for broken JSON."""

    def one(raw: str | None) -> list[dict] | None:
        try:
            waiting = [(node, 0, f"/{i}") for i, node in enumerate(json.loads(raw))][::-1] if raw is not None else None
        except ValueError:
            return None
        out = []
        while waiting:
            node, depth, path = waiting.pop()
            key = node.get("value", node.get("key"))
            out.append({"key": None if key is None else str(key), "name": node.get("name"), "depth": depth, "path": path})
            waiting += [(child, depth + 1, f"{path}/{i}") for i, child in enumerate(node.get("children") or [])][::-1]
        return out

    return trees.map(one)


def trend(values: DataFrame, key: str, period: str = "period_raw") -> DataFrame:
    """A row's amount and its disclosed growth (the row with ``_2`` after its key), by period."""
    return values.where(F.col("row_key").isin(key, f"{key}_2")).groupBy("module_key", period).agg(
        F.max(F.when(F.col("row_key") == key, F.col("value"))).alias("amount"), F.max(F.when(F.col("row_key") == f"{key}_2", F.col("value"))).alias("growth")
    )


def batch_quality(done: str, failed: str, gaps: str) -> Column:
    """failed, passed_with_gaps, warning or passed, from counts of modules."""
    return F.when(F.col(done) == 0, "failed").when(F.col(failed) > 0, "passed_with_gaps").when(F.col(gaps) > 0, "warning").otherwise("passed")


# Payloads as providers send them -------------------------------------------------

#: A matrix: heads and keys of its columns, the first of which is the period, and rows of values.
MATRIX = "struct<data:struct<head:array<string>,key:array<string>,unit:array<string>,level:array<int>,value:array<array<string>>>>"


#: A cell of a matrix, and the parts of a payload that its fields come from.
CELL = {"key": "key", "name": "head", "unit": "unit", "level": "level"}


def matrix_columns(raw: DataFrame, ids: list[str], column: str = "payload") -> DataFrame:
    """Columns of matrix payloads: ids, state, period_ordinal, period and cells (array<struct<row_ordinal,key,name,unit,level,value>>), those of each in its row.

    state is ok, structure_changed or empty_module; of the latter two there is one
    row, without cells. Every row of values must be as long as the heads.
    """
    x = F.col("x.data")
    even = F.forall(x["value"], lambda r: F.coalesce(F.size(r) == F.size(x["head"]), F.lit(False)))
    state = (
        F.when(F.col("x").isNull() | x.isNull() | x["head"].isNull() | x["key"].isNull() | x["value"].isNull(), "structure_changed").when(F.size(x["value"]) == 0, "empty_module")
        .when((F.size(x["head"]) != F.size(x["key"])) | (F.size(x["head"]) == 0) | ~even, "structure_changed").otherwise("ok")
    )
    read = raw.select(*ids, F.from_json(column, MATRIX).alias("x")).withColumn("state", state)
    fine, width = F.col("state") == "ok", F.size(x["head"]) - 1
    # the period's own field is cut off; a payload may say nothing of units or levels
    parts = [F.when(fine, F.coalesce(F.slice(x[part], F.lit(2), width), F.array().cast("array<int>" if part == "level" else "array<string>"))).alias(part) for part in CELL.values()]
    each = read.select(*ids, "state", *parts, F.posexplode_outer(F.when(fine, x["value"])).alias("period_ordinal", "r"))
    rest = F.slice("r", F.lit(2), F.size("r") - 1)
    places = F.when(F.size("r") > 1, F.sequence(F.lit(0), F.size("r") - 2)).otherwise(F.array().cast("array<int>"))
    cells = F.when(fine, F.arrays_zip(places.alias("row_ordinal"), *[F.col(part).alias(name) for name, part in CELL.items()], rest.alias("value")))
    return each.select(*ids, "state", "period_ordinal", F.get("r", F.lit(0)).alias("period"), cells.alias("cells"))


def provider_matrix(raw: DataFrame, ids: list[str], column: str = "payload") -> DataFrame:
    """Cells of matrix payloads: ids, row_ordinal, key, name, unit, level, period_ordinal, period, value and state.

    state as in ``matrix_columns``: of payloads that aren't ok there is one row, without cells.
    """
    found = matrix_columns(raw, ids, column).select(*ids, "state", "period_ordinal", "period", F.explode_outer("cells").alias("c"))
    return found.select(*ids, "c.row_ordinal", "c.key", "c.name", "c.unit", "c.level", "period_ordinal", "period", "c.value", "state")


def provider_analysis(raw: DataFrame, ids: list[str], column: str = "payload") -> DataFrame:
    """Cells of analysis payloads (a tree of fields, and records): ids, row_ordinal, key, name, depth, path, period_ordinal, period, value.

    The period is the first top field whose key begins with reportDate. Payloads
    without fields or records, or with a record without a period, give no rows.
    """
    read = raw.select(*ids, tree_rows(F.get_json_object(column, "$.data.fieldList")).alias("fields"), F.from_json(F.get_json_object(column, "$.data.dataList"), "array<map<string,string>>").alias("records"))
    dated = F.filter("fields", lambda f: (f["depth"] == 0) & f["key"].startswith("reportDate"))
    read = read.withColumn("period_field", F.coalesce(F.get(dated, F.lit(0))["key"], F.lit("reportDate")))
    read = read.where(F.coalesce(F.forall("records", lambda r: F.try_element_at(r, F.col("period_field")).isNotNull()) & (F.size("records") > 0), F.lit(False)))
    rows = read.select(*ids, "records", "period_field", F.posexplode(F.filter("fields", lambda f: f["key"].isNotNull() & (f["key"] != F.col("period_field")))).alias("row_ordinal", "f"))
    cells = rows.select(*ids, "row_ordinal", "f", "period_field", F.posexplode("records").alias("period_ordinal", "r"))
    return cells.select(*ids, "row_ordinal", "f.key", "f.name", "f.depth", "f.path", "period_ordinal", F.try_element_at("r", F.col("period_field")).alias("period"), F.try_element_at("r", F.col("f.key")).alias("value"))


def provider_records(raw: DataFrame, ids: list[str], column: str = "payload") -> DataFrame:
    """Cells of record payloads whose head names a report before each group of entries: ids, record, report, entry, field and value.

    A label like 2025年年报 opens a group, and the first one must stand right behind
    the first label; else, or with rows that aren't as long as the head, there are no rows.
    """
    read = raw.select(*ids, F.from_json(F.get_json_object(column, "$.data.head"), "array<string>").alias("head"), F.from_json(F.get_json_object(column, "$.data.value"), "array<array<string>>").alias("rows"))
    marks = F.filter(F.transform("head", lambda h, i: F.when((i > 0) & h.rlike("^[0-9]{4}年(?:年报|中报)$"), i)), lambda i: i.isNotNull())
    read = read.withColumn("marks", marks).where((F.get("marks", F.lit(0)) == 1) & F.forall("rows", lambda r: F.size(r) == F.size("head")))
    each = read.select(*ids, "marks", "rows", F.posexplode("head").alias("at", "entry"), "head")
    own = F.array_max(F.filter("marks", lambda m: m <= F.col("at")))
    each = each.withColumn("mark", own).where("at > 0 AND at <> mark")
    cells = each.select(*ids, "at", "entry", "mark", "marks", "head", F.posexplode("rows").alias("field_ordinal", "r"))
    return cells.select(
        *ids, F.array_position("marks", F.col("mark")).cast("int").alias("record"), F.get("head", F.col("mark")).alias("report"), "entry", "field_ordinal", F.get("r", F.lit(0)).alias("field"), F.get("r", F.col("at")).alias("value")
    )


def view_kind(payload: Column) -> Column:
    """How a parsed module is shown: empty, matrix, records or notes (records whose rows are dates, shown as a matrix)."""
    part = lambda path: F.get_json_object(payload, path)
    head, rows = part("$.head"), part("$.rows")
    some = lambda x: F.coalesce(x.isNotNull() & (x != "[]"), F.lit(False))
    dated = F.coalesce(F.forall(F.from_json(rows, "array<array<string>>"), lambda r: F.get(r, F.lit(0)).rlike("^[0-9]{8}$")), F.lit(False)) & (part("$.category") == "notes")
    return (
        F.when(F.coalesce(part("$.metadata.unavailable") == "true", F.lit(False)), "empty").when(some(part("$.periods")) & some(rows) & ~rows.startswith("[["), "matrix")
        .when(some(head) & head.startswith("[["), "records").when(some(head) & some(rows), F.when(dated, "notes").otherwise("records")).otherwise("empty")
    )


def search_candidates(raw: DataFrame, ids: list[str], column: str = "payload") -> DataFrame:
    """All companies that a search found: ids, code, name, identity (the whole entry). Entries without a code or name are structure_changed."""
    item = F.explode(F.from_json(F.get_json_object(column, "$.data.list"), "array<string>"))
    each = raw.select(*ids, item.alias("identity"))
    code, name = F.get_json_object("identity", "$.code"), F.get_json_object("identity", "$.name")
    state = F.when((F.coalesce(code, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == ""), "structure_changed").otherwise("ok")
    return each.select(*ids, code.alias("code"), name.alias("name"), "identity", state.alias("state"))


# Statements and tables of values -------------------------------------------------

#: Provider names of scopes and currencies. Fixed values.
SCOPES = {"1": "consolidated", "2": "parent", "合并期末": "consolidated", "母公司期末": "parent"}
CURRENCIES = {"人民币": "CNY", "美元": "USD", "日元": "JPY", "港元": "HKD", "英镑": "GBP", "欧元": "EUR", "加拿大元": "CAD", "澳大利亚元": "AUD", "O": "unknown"}
#: A row of cash flow statements that has a standard name but another meaning.
UNMAPPED_KEY = "130065"


def column_facts(values: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """What the metadata rows say of each column: ids, period_ordinal and a column for each key."""
    return values.where(F.col("key").isin(keys)).groupBy(*ids, "period_ordinal").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def suffix_unit(header: Column) -> Column:
    """The unit in parentheses at a header's end, or null."""
    return F.nullif(F.regexp_extract(header, "[（(]([^（）()]+)[）)]$", 1), F.lit(""))


def provider_statements(values: DataFrame, modules: DataFrame, ids: list[str]) -> DataFrame:
    """Facts of provider statements: one for each row and column of money.

    ``values``: ids, row_ordinal, key, name, unit, period_ordinal, period, value.
    ``modules``: ids, statement_type, entity, unit, merge_range, currency and
    headers (the export's, one more than rows). The unit is the headers' first money
    unit, else the request's, else yuan; a row's own header or unit goes before. Scope
    and currency come from the column's metadata, else from the request, else are
    unknown. Growth and composition columns, and metadata rows, are no facts.
    """
    told = column_facts(values, ids, ["dataType", "deadline", "displayCurrency", "originalCurrency"])
    first = F.get(F.filter(F.transform("headers", suffix_unit), lambda u: u.isin(list(UNIT_SCALES))), F.lit(0))
    known = modules.withColumn("module_unit", F.coalesce(first, F.nullif("unit", F.lit("")), F.lit("元"))).drop("unit")
    rows = values.where(~F.col("key").isin(METADATA_ROWS)).join(known, ids).join(told, [*ids, "period_ordinal"], "left").where(~F.coalesce(F.col("dataType").rlike("[%％]"), F.lit(False)))
    scope = F.coalesce(F.nullif("dataType", F.lit("")), F.col("merge_range"))
    currency = F.coalesce(F.nullif("displayCurrency", F.lit("")), F.col("currency"), F.lit("unknown"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("key"), F.lit(""))
    barred = (F.col("statement_type") == "cash_flow_statement") & (F.col("key") == UNMAPPED_KEY)
    standard = F.when(~barred, lookup(clean_label(name), ALIASES))
    unit = F.coalesce(suffix_unit(F.get("headers", F.col("row_ordinal") + 1)), F.nullif("unit", F.lit("")), F.col("module_unit"))
    amount = F.when(~F.coalesce(F.col("value") == "", F.lit(True)), (loose_number(F.col("value")) * F.col("_r.scale")).cast("decimal(28,8)"))
    disclosed = F.concat(F.lit("disclosed_"), F.substring(F.sha2(name, 256), 1, 32))
    # exploded so that a label, a unit and an amount are read once, in methods of their own that are small enough to be compiled
    rows = rows.select("*", F.explode(F.array(bound(unit, lambda u: F.struct(u.alias("unit"), F.when(u.isin(list(UNIT_SCALES)), unit_scale(u)).alias("scale"), standard.alias("standard"))))).alias("_r"))
    rows = rows.select("*", F.explode(F.array(amount)).alias("_amount"))
    standard, unit, amount = F.col("_r.standard"), F.col("_r.unit"), F.col("_amount")
    return rows.select(
        *ids, "statement_type", "entity", F.coalesce(lookup(scope, SCOPES), F.when(scope.isin("consolidated", "parent"), scope), F.lit("unknown")).alias("scope"), F.coalesce(lookup(currency, CURRENCIES), currency).alias("currency"),
        "period", F.coalesce(F.nullif("deadline", F.lit("")), "period").alias("period_normalized"), F.when(F.col("statement_type") == "balance_sheet", "instant").otherwise("duration").alias("period_kind"),
        "row_ordinal", "period_ordinal", F.coalesce(standard, disclosed).alias("concept"), F.when(standard.isNull(), "unmapped").otherwise("mapped").alias("mapping_state"), name.alias("source_name"),
        F.col("value").alias("raw_value"), unit.alias("raw_unit"), amount.alias("value"), F.when(amount.isNotNull(), exponent_increment(F.col("value"))).alias("source_increment"),
        F.when(amount.isNull(), "source_value_not_found").otherwise("source_verified").alias("status"),
    )


def _end(period: Column) -> Column:
    """Day on which a period like 20251231 or 2025-12-31 ends; null for another text."""
    return F.try_to_date(F.when(period.rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}$"), F.replace(period, F.lit("-"), F.lit(""))), "yyyyMMdd")


REPORT_NAMES = {"annual": "年报", "q3": "三季报", "half": "中报", "q1": "一季报"}


def module_table(
    values: DataFrame, ids: list[str], report: str = "all", start: int | None = None, end: int | None = None, window_years: int = 0, scopes: str = "all", data_kinds: str = "all",
    hide_empty: bool = False, unit: str = "元", decimals: int = 2,
) -> DataFrame:
    """A module's matrix as it is shown or exported: filters of columns together, blank rows hidden, amounts in another unit.

    ``values``: columns as in ``matrix_columns``, or cells as in ``provider_statements``.
    Returns ids, row_ordinal, key, name,
    period, period_label, report_order, place (of the column, the latest first) and
    shown. Columns pass every filter: kinds of report (a comma list), years, the last
    years of quarters up to the module's latest, scopes and kinds of data. Rows of
    metadata stay, as text. Money is rounded half up; percent columns aren't scaled.
    """
    wanted = set(report.split(","))
    if wanted - set(REPORTS) or window_years not in WINDOWS or unit not in UNIT_SCALES or not 0 <= decimals <= 6 or (start and end and start > end):
        raise ValueError("invalid_export_options")
    if "cells" not in values.columns:
        values = values.groupBy(*ids, "period_ordinal", "period").agg(F.collect_list(F.struct("row_ordinal", "key", "name", "unit", "value")).alias("cells"))  # one column's cells
    module = W.partitionBy(*ids)
    told = F.array_max(F.transform(F.filter("cells", lambda c: c["key"] == "dataType"), lambda c: c["value"]))
    columns = values.where("period_ordinal IS NOT NULL").select(*ids, "period_ordinal", "period", "cells", told.alias("dataType"), _end(F.col("period")).alias("closing"))
    columns = columns.withColumn("report_order", F.coalesce(report_order(F.col("closing")), F.lit(0))).withColumn("kind", report_kind(F.col("closing")))
    scope, data_kind = scope_and_kind(F.coalesce("dataType", F.lit("")))
    keep = F.lit("all" in wanted) | F.coalesce(F.col("kind").isin(sorted(wanted)), F.lit(False))
    keep = keep | (F.lit("quarter" in wanted) & F.coalesce(F.col("kind").isin("q1", "q3"), F.lit(False)))
    # a module's last report and quarter are sought only where they are asked for, over columns that no filter has left out yet
    if "latest" in wanted:
        columns = columns.withColumn("_top", F.max("report_order").over(module))
        keep = keep | (F.col("report_order") == F.col("_top"))
    year = F.regexp_extract("period", "^[0-9]{4}", 0)
    keep = keep & (year >= str(start or "")) & (year <= str(end) if end else F.lit(True))
    if window_years:
        quarter = quarter_index(F.col("closing"))
        columns = columns.withColumn("_last", F.max(quarter).over(module))
        keep = keep & F.coalesce(quarter > F.col("_last") - 4 * window_years, F.lit(False))
    if scopes != "all":
        keep = keep & scope.isin(scopes.split(","))
    if data_kinds != "all":
        keep = keep & data_kind.isin(data_kinds.split(","))
    label = F.coalesce(F.concat(F.year("closing").cast("string"), F.lit("年"), lookup(F.col("kind"), REPORT_NAMES)), F.col("period"))
    share = F.coalesce(F.col("dataType").rlike("[%％]") | F.col("dataType").isin("同比", "占收入比"), F.lit(False))
    place = F.row_number().over(module.orderBy(F.desc("report_order"), "period_ordinal"))
    columns = columns.where(keep).select(*ids, "period", label.alias("period_label"), "report_order", share.alias("_share"), "cells", place.alias("place"))
    cells = columns.select(*[c for c in columns.columns if c != "cells"], F.explode_outer("cells").alias("c")).where("c IS NOT NULL").select("*", "c.*").drop("c")
    if hide_empty:
        cells = cells.withColumn("_filled", F.bool_or(~is_blank_export(F.col("value"))).over(W.partitionBy(*ids, "row_ordinal"))).where("_filled")
    number = F.col("value").try_cast("decimal(28,8)")
    money = F.col("unit").isin(list(UNIT_SCALES)) & ~F.col("_share") & ~F.col("key").isin(METADATA_ROWS)
    amount = F.when(money, convert_unit(number, F.col("unit"), F.lit(unit))).otherwise(number)
    shown = F.when(~F.col("key").isin(METADATA_ROWS), F.round(amount, decimals).cast(f"decimal(38,{decimals})").cast("string"))
    return cells.select(*ids, "row_ordinal", "key", "name", "period", "period_label", "report_order", "place", F.coalesce(shown, F.col("value")).alias("shown"))


#: Statement -> suffixes of its series: the amount (empty), then disclosed ratios. Fixed values.
SERIES = {"balance_sheet": ["较年初比(%)", "同比(%)", "销售比(%)", "资产比(%)", "环比(%)"], "income_statement": ["", "同比(%)", "销售比(%)"], "cash_flow_statement": ["", "同比(%)"]}


def statement_trend(values: DataFrame, ids: list[str], key: str, statement_type: str, scope: str) -> DataFrame:
    """A row's disclosed series by period: ids, period and a column for each suffix (amount for the empty one).

    A series is the column whose data type is the scope with the suffix; the first
    such column of a period counts.
    """
    if scope not in ("合并期末", "母公司期末") or statement_type not in SERIES:
        raise ValueError("invalid_trend_options")
    told = column_facts(values, ids, ["dataType"])
    own = values.where(F.col("key") == key).join(told, [*ids, "period_ordinal"])
    pick = lambda s: F.min(F.when(F.col("dataType") == scope + s, F.struct("period_ordinal", "value")))["value"].alias(s.replace("(%)", "") or "amount")
    return own.groupBy(*ids, "period").agg(*[pick(s) for s in SERIES[statement_type]])
