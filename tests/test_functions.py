from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brightledger.functions import numbers as N
from brightledger.functions import periods as P
from brightledger.functions import text as T


def over(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_three_readers_differ(spark):
    texts = ["1,234", "12,34", "1e3", "(5)", "-7.50", "5%", "1,234,", "—", "", None]
    d = Decimal
    as_is = lambda found: [None if v is None else v.normalize() for v in found]
    assert as_is(over(spark, texts, N.loose_number)) == as_is([d(1234), d(1234), d(1000), d(-5), d("-7.5"), None, d(1234), None, None, None])
    assert as_is(over(spark, texts, N.strict_number)) == as_is([d(1234), None, None, d(-5), d("-7.5"), None, None, None, None, None])
    assert as_is(over(spark, texts, N.note_number)) == as_is([d(1234), None, d(1000), d(-5), d("-7.5"), d(5), None, None, None, None])


def test_display_rounds_half_up_and_has_no_negative_zero(spark):
    assert over(spark, [Decimal("2.345"), Decimal("-2.345"), Decimal("-0.001"), Decimal("1234567.885")], lambda c: N.half_up(c, 2), "decimal(18,3)") == ["2.35", "-2.35", "0.00", "1,234,567.89"]


def test_canonical_decimal(spark):
    assert over(spark, ["1.500", "0010", "-0.00", "100", "0.0", "12.0"], N.canonical_decimal) == ["1.5", "10", "0", "100", "0", "12"]


def test_increment_and_units(spark):
    assert over(spark, ["1.25", "7", "x"], N.source_increment) == [Decimal("0.01000000"), Decimal("1.00000000"), None]
    assert over(spark, ["万元", "股"], N.unit_scale) == [Decimal(10000), None]


@pytest.mark.parametrize(
    ("raw", "kind", "expected"),
    [
        ("2026H1", "income_statement", ("2026-01-01/2026-06-30", "half_year")), ("2026年1—6月", "income_statement", ("2026-01-01/2026-06-30", "half_year")),
        ("2024年2-2月", "income_statement", ("2024-02-01/2024-02-29", "duration")), ("2025Q4", "income_statement", ("2025-10-01/2025-12-31", "quarter")),
        ("2025年度", "income_statement", ("2025-01-01/2025-12-31", "year")), ("2026-01-01", "balance_sheet", ("2025-12-31", "instant")),
        ("2026-01-01", "income_statement", ("2026-01-01", "instant")), ("2026年9-3月", "income_statement", None), ("whenever", "balance_sheet", None),
    ],
)
def test_periods(spark, raw, kind, expected):
    found = over(spark, [raw], lambda c: P.normalize_period(c, F.lit(kind)))[0]
    assert (tuple(found) if found else None) == expected


def test_offsets_guard_leap_days(spark):
    import datetime as dt

    days = [dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert over(spark, days, P.year_before, "date") == [None, dt.date(2023, 3, 31)]
    assert over(spark, days, P.quarter_end_before, "date") == [dt.date(2023, 11, 30), dt.date(2023, 12, 31)]


def test_labels(spark):
    assert over(spark, ["一、营业收入", "其中：存货（净亏损）", "(二)净利润（亏损以“-”号填列）", None], T.clean_label) == ["营业收入", "存货", "净利润", None]
    found = over(spark, ["营业收入", "某某"], lambda c: T.concept_for(c, F.lit("income_statement")))
    assert found[0] == "revenue" and found[1].startswith("disclosed_") and len(found[1]) == 42


def test_ages_numerals_and_guards(spark):
    assert over(spark, ["1年以内（含1年）", "1至2年", "合计"], T.age_label) == ["1年内", "1-2年", "合计"]
    assert over(spark, ["三", "十", "十二", "二十", "九十九", "零"], T.section_number) == [3, 10, 12, 20, 99, None]
    assert over(spark, ["=1", "-5", "-a", "a"], T.csv_guard) == ["'=1", "-5", "'-a", "a"]
    assert over(spark, ["年报__https://x.cn/a", "年报"], T.link_url) == ["https://x.cn/a", None]
