"""Reporting periods: readers, offsets, kinds and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = r"^([0-9]{4})年([0-9]{1,2})[-—–至到]([0-9]{1,2})月$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used: plans stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).cast("int")


def _span(year: Column, first: Column, last: Column) -> Column:
    """start/end of whole months."""
    start = F.make_date(year, first, F.lit(1))
    return F.concat(start.cast("string"), F.lit("/"), F.last_day(F.make_date(year, last, F.lit(1))).cast("string"))


def normalize_period(text: Column, statement_type: Column) -> Column:
    """struct(period, kind) of H1, quarters, spans of months, years and dates; null if unreadable.

    A balance sheet of the first of January is the end of the year before.
    """
    return bound(F.upper(F.trim(text)), lambda t: _normalized(t, statement_type))


def _normalized(t: Column, statement_type: Column) -> Column:
    half = F.coalesce(_part(t, r"^([0-9]{4})H1$", 1), _part(t, r"^([0-9]{4})年(?:1[-—–至到]6月|半年度)$", 1))
    year, first, last = (_part(t, _MONTHS, g) for g in (1, 2, 3))
    spans = year.isNotNull() & first.between(1, 12) & last.between(1, 12) & (first <= last)
    quarter_year, quarter = (_part(t, r"^([0-9]{4})Q([1-4])$", g) for g in (1, 2))
    whole = _part(t, r"^([0-9]{4})年度$", 1)
    dated = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    before = F.concat(F.lpad((F.substring(t, 1, 4).cast("int") - 1).cast("string"), 4, "0"), F.lit("-12-31"))
    kind = (
        F.when((first == 1) & (last == 12), "year").when((first == 1) & (last == 6), "half_year")
        .when((last == first + 2) & (first % 3 == 1), "quarter").otherwise("duration")
    )
    made = lambda period, name: F.struct(period.alias("period"), (name if isinstance(name, Column) else F.lit(name)).alias("kind"))
    return (
        F.when(half.isNotNull(), made(_span(half, F.lit(1), F.lit(6)), "half_year"))
        .when(spans, made(_span(year, first, last), kind))
        .when(quarter_year.isNotNull(), made(_span(quarter_year, quarter * 3 - 2, quarter * 3), "quarter"))
        .when(dated & (statement_type == "balance_sheet") & t.endswith("-01-01"), made(before, "instant"))
        .when(dated, made(t, "instant"))
        .when(whole.isNotNull(), made(_span(whole, F.lit(1), F.lit(12)), "year"))
    )


def report_end(text: Column) -> Column:
    """End of the period that a report's first 6000 characters name."""
    pattern = r"(20[0-9]{2})\s*年\s*(半年度|年度|第一季度|第三季度)报告"
    year, kind = (F.regexp_extract(F.substring(text, 1, 6000), pattern, g) for g in (1, 2))
    end = F.when(kind == "半年度", "-06-30").when(kind == "年度", "-12-31").when(kind == "第一季度", "-03-31").when(kind == "第三季度", "-09-30")
    return F.when(year != "", F.concat(year, end)).cast("date")


def year_before(day: Column) -> Column:
    """The same day a year earlier; null for the 29th of February, which has none."""
    return F.when(~((F.month(day) == 2) & (F.dayofmonth(day) == 29)), F.add_months(day, -12))


def quarter_end_before(day: Column) -> Column:
    """End of the month three months earlier."""
    return F.last_day(F.add_months(F.trunc(day, "month"), -3))


def day_before(day: Column) -> Column:
    return F.date_sub(day, 1)


def days_30_360(start: Column, end: Column) -> Column:
    """30 for each month of a span of whole months; null for another span."""
    months = (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start)) + 1
    return F.when((F.dayofmonth(start) == 1) & (end == F.last_day(end)), months * 30)


def align_balance(day: Column, label: Column) -> Column:
    """An opening balance of the first of January belongs to the year before, unless it is marked as adjusted."""
    opening = (F.month(day) == 1) & (F.dayofmonth(day) == 1) & ~F.coalesce(label.rlike("调整前|调整后"), F.lit(False))
    return F.when(opening, F.date_sub(day, 1)).otherwise(day)


def report_kind(end: Column) -> Column:
    """Kind of report that closes on a day."""
    month_day = F.date_format(end, "MMdd")
    return F.when(month_day == "1231", "annual").when(month_day == "0930", "q3").when(month_day == "0630", "half").when(month_day == "0331", "q1")


def report_order(end: Column) -> Column:
    """Sort key of reports: year, then annual, third quarter, half year, first quarter."""
    kind = report_kind(end)
    rank = F.when(kind == "annual", 4).when(kind == "q3", 3).when(kind == "half", 2).when(kind == "q1", 1).otherwise(0)
    return F.year(end) * 10 + rank


def quarter_index(end: Column) -> Column:
    return F.year(end) * 4 + F.quarter(end)


def period_label(end: Column, kind: Column) -> Column:
    year = F.year(end).cast("string")
    return (
        F.when(kind == "year", F.concat(year, F.lit("年度"))).when(kind == "half_year", F.concat(year, F.lit("年半年度")))
        .when(kind == "quarter", F.concat(year, F.lit("年第"), F.quarter(end).cast("string"), F.lit("季度"))).otherwise(end.cast("string"))
    )


def strict_period(text: Column, kind: Column, statement_type: Column) -> Column:
    """struct(period, kind, fault) of a claimed period: a token, a written date or an ISO span.

    fault (null if there is none): period_unknown, period_order, period_invalid,
    balance_requires_instant, flow_requires_duration or period_kind_mismatch, the
    first that applies. A claimed kind may be null; of a span, duration fits every kind.
    """
    bare = F.translate(F.regexp_replace(text, r"\s+", ""), "（），", "(),")
    written = r"^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日(?:\((?:调整前|调整后)\))?$"
    part = lambda x, g, n: F.lpad(F.regexp_extract(x, written, g), n, "0")
    dashed = lambda x: F.when(x.rlike(written), F.concat_ws("-", part(x, 1, 4), part(x, 2, 2), part(x, 3, 2))).otherwise(x)
    claim = lambda v: F.when(v.contains("/"), _span_claim(v, kind, statement_type)).otherwise(bound(normalize_period(v, statement_type), lambda t: _token_claim(v, t, kind, statement_type)))
    return bound(bound(bare, dashed), claim)


def _day(text: Column) -> Column:
    return F.try_to_date(F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text), "yyyy-MM-dd")


def _claimed(fault: Column, period: Column, kind: Column) -> Column:
    return bound(fault, lambda f: F.struct(F.when(f.isNull(), period).alias("period"), F.when(f.isNull(), kind).alias("kind"), f.alias("fault")))


def _span_claim(value: Column, kind: Column, statement_type: Column) -> Column:
    """A claimed start/end."""
    ends = F.split(value, "/")
    start, end = _day(F.get(ends, F.lit(0))), _day(F.get(ends, F.lit(1)))
    bounds = F.concat(F.date_format(start, "MMdd"), F.date_format(end, "MMdd"))
    found = (
        F.when(F.year(start) != F.year(end), "duration").when(bounds == "01011231", "year").when(bounds == "01010630", "half_year")
        .when(bounds.isin("01010331", "04010630", "07010930", "10011231"), "quarter").otherwise("duration")
    )
    fault = lambda actual: (
        F.when((F.size(ends) != 2) | start.isNull() | end.isNull(), "period_invalid").when(start > end, "period_order").when(statement_type == "balance_sheet", "balance_requires_instant")
        .when(kind.isNotNull() & (kind != "duration") & (kind != actual), "period_kind_mismatch")
    )
    return bound(found, lambda actual: _claimed(fault(actual), value, F.coalesce(kind, actual)))


def _token_claim(value: Column, token: Column, kind: Column, statement_type: Column) -> Column:
    """A claimed date or token, as ``normalize_period`` reads it."""
    balance, instant = statement_type == "balance_sheet", token["kind"] == "instant"
    fault = (
        F.when(token.isNull(), "period_unknown").when(instant & _day(value).isNull(), "period_invalid").when(balance & ~instant, "balance_requires_instant")
        .when(~balance & instant, "flow_requires_duration").when(kind.isNotNull() & (kind != token["kind"]), "period_kind_mismatch")
    )
    return _claimed(fault, token["period"], token["kind"])


def supplement_period(end: Column) -> Column:
    """struct(period, kind, previous) of the flows that a report of an end supplements: from the first of January, and the same a year before."""
    year = lambda back: (F.year(end) - back).cast("string")
    span = lambda back: F.concat(year(back), F.lit("-01-01/"), year(back), F.lit("-"), F.date_format(end, "MM-dd"))
    kind = F.when(F.date_format(end, "MMdd") == "1231", "year").when(F.date_format(end, "MMdd") == "0630", "half_year").otherwise("year_to_date")
    return F.struct(span(0).alias("period"), kind.alias("kind"), span(1).alias("previous"))
