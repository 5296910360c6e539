"""Period matrices: pivots, filters, ordering and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.periods import quarter_index, report_kind, report_order
from ..functions.text import is_blank_export

#: Suffix of a column's name -> kind of data. Fixed values.
DATA_KINDS = {"较年初比(%)": "较年初增长率", "同比(%)": "同比增长率", "销售比(%)": "销售百分比", "资产比(%)": "资产百分比", "环比(%)": "环比增长率"}
#: Column names that are a kind of data themselves, of no scope. Fixed values.
PLAIN_KINDS = ["原始报表", "同比", "占收入比"]
REPORTS = ["all", "latest", "annual", "q3", "half", "q1", "quarter"]
WINDOWS = [0, 3, 5, 10]


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, cell: Column) -> DataFrame:
    """Long to wide over a fixed list of column values: one shuffle, no scan to find them."""
    return df.groupBy(*rows).pivot(column, values).agg(cell)


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def transposed(df: DataFrame, row: str, columns: list[str], values: list) -> DataFrame:
    """Rows become columns: for every column a row, for every listed value of ``row`` a column."""
    return pivoted(df.unpivot([row], columns, "field", "value"), ["field"], row, values, F.max("value"))


def year_range(end: Column, first: int | None, last: int | None) -> Column:
    keep = F.lit(True)
    if first is not None:
        keep = keep & (F.year(end) >= first)
    if last is not None:
        keep = keep & (F.year(end) <= last)
    return keep


def report_filter(df: DataFrame, end: str, reports: str, keys: list[str] | None = None) -> DataFrame:
    """Rows whose report is one of a comma list of kinds; latest means the last one of ``keys``."""
    wanted = [r.strip() for r in reports.split(",") if r.strip()]
    if not wanted or set(wanted) - set(REPORTS):
        raise ValueError(f"invalid_export_options: report {reports!r}")
    if "all" in wanted:
        return df
    kind, order = report_kind(F.col(end)), report_order(F.col(end))
    keep = kind.isin([r for r in wanted if r not in ("latest", "quarter")])
    if "quarter" in wanted:
        keep = keep | kind.isin("q1", "q3")
    keep = F.coalesce(keep, F.lit(False))
    if "latest" not in wanted:
        return df.where(keep)
    last = order == F.max(order).over(W.partitionBy(*(keys or [])))
    if not keys:  # the last report of all: a scalar aggregate, not a window over one partition
        top = df.agg(F.max(order).alias("_top"))
        return df.join(F.broadcast(top), order == F.col("_top"), "left").where(keep | F.col("_top").isNotNull()).drop("_top")
    return df.withColumn("_keep", keep | last).where("_keep").drop("_keep")


def rolling_years(df: DataFrame, end: str, keys: list[str], years: int) -> DataFrame:
    """The last ``years`` years of quarters of each key, up to its latest."""
    if years not in WINDOWS:
        raise ValueError(f"invalid_export_options: window {years}")
    if not years:
        return df
    quarter = quarter_index(F.col(end))
    return df.withColumn("_top", F.max(quarter).over(W.partitionBy(*keys))).where(quarter > F.col("_top") - 4 * years).drop("_top")


def scope_and_kind(name: Column) -> tuple[Column, Column]:
    """(scope, kind of data) of a provider column named like 合并期末同比(%)."""
    scope = F.regexp_extract(name, "^(?:合并|母公司)期[初末]", 0)
    scope = F.when(name.isin(PLAIN_KINDS), "").when(scope == "", name).otherwise(scope)
    suffix = F.when(name.isin(PLAIN_KINDS), name).otherwise(F.substring(name, F.length(scope) + 1, F.length(name)))
    kinds = F.create_map(*[F.lit(x) for pair in DATA_KINDS.items() for x in pair])
    return scope, F.coalesce(F.try_element_at(kinds, suffix), F.when(suffix == "", "原始报表").otherwise(suffix))


def column_filter(df: DataFrame, name: str, scopes: str = "all", kinds: str = "all") -> DataFrame:
    """Provider columns of the wanted scopes and kinds of data, each a comma list or all."""
    scope, kind = scope_and_kind(F.col(name))
    if scopes not in ("", "all"):
        df = df.where(scope.isin(scopes.split(",")))
    return df if kinds in ("", "all") else df.where(kind.isin(kinds.split(",")))


def hide_empty_rows(df: DataFrame, rows: list[str], value: str, section: Column | None = None) -> DataFrame:
    """Rows of a matrix in long form with a value that isn't blank in any column, and sections; zero isn't blank."""
    filled = df.groupBy(*rows).agg(F.bool_or(~is_blank_export(F.col(value).cast("string"))).alias("_f"), *([F.bool_or(section).alias("_s")] if section is not None else []))
    keep = filled.where(F.col("_f") | F.col("_s") if section is not None else F.col("_f"))
    return df.join(keep.select(*rows), rows, "left_semi")


def collapse(path: Column, collapsed: Column) -> Column:
    """Whether a row stays in sight: no collapsed path is an ancestor of its own."""
    return ~F.exists(collapsed, lambda c: F.startswith(path, F.concat(c, F.lit("/"))))


def axis_scale(most: Column) -> Column:
    """Magnitude (a power of ten) of a chart's axis."""
    size = F.abs(most)
    return F.when(size >= 1e12, 12).when(size >= 1e9, 9).when(size >= 1e6, 6).when(size >= 1e3, 3).otherwise(0)
