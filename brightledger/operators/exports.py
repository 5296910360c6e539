"""How exported rows are numbered and how their cells are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import strict_number

#: Significant digits that a spreadsheet's numbers hold. Fixed value.
MOST_DIGITS = 15


def serial_numbers(rows: DataFrame, keys: list[str], order: list[Column], shown: Column, section: Column) -> DataFrame:
    """``rows`` with serial: the shown rows of each key are numbered from 1 across all sections; the sections' own rows and hidden ones have none."""
    counts = shown & ~section
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("serial", F.when(counts, F.count_if(counts).over(before)))


def cell_format(raw: Column, decimals: int) -> tuple[Column, Column]:
    """(kind, format) of a cell: a number with its format, or text where it is none or has more digits than a spreadsheet's numbers hold.

    A percentage keeps its sign in the format; its digits stay as they were disclosed.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, r"[\s,，()（）%％+-]", ""), r"^0+(?=[0-9])", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(bare, r"^0?\.0*", ""), r"\.", ""))
    percent = raw.rlike(r"[%％]\s*$")
    number = strict_number(F.regexp_replace(raw, r"\s*[%％]\s*$", "")).isNotNull() & (digits <= MOST_DIGITS)
    shown = "#,##0" + ("." + "0" * decimals if decimals else "")
    kind = F.when(F.coalesce(number, F.lit(False)), F.when(percent, "percent").otherwise("number")).otherwise("text")
    return kind, F.when(kind == "number", shown).when(kind == "percent", "0.00%").otherwise("@")
