"""What is wrong with a reader's claims and metadata as such: a table's cells, columns and claims meet in one shuffle, by its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import quoted_number
from ..functions.periods import bound
from ..functions.text import BLANK_SOURCE, compact_quote
from .validation import BLOCK

#: What is known of a cell that isn't blank, and of a claim, as bits: TOP_YEAR is a year that heads its column wherever its row is a header's.
NUMBER, YEAR, TOP_YEAR, UNREADABLE, CLAIM, DATA_CLAIM = (1 << i for i in range(6))


def _flag(when: Column, bit: int) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), bit).otherwise(0)


def _holds(array: str, x: Column) -> Column:
    return F.coalesce(F.array_contains(array, x), F.lit(False))


def _declared(columns: DataFrame) -> DataFrame:
    """Of each table: declared (array<struct<col,times,label_column,header_rows>>), its label columns, and heads, the rows of all headers."""
    own = columns.groupBy(*BLOCK).agg(F.collect_list(F.struct("column", "label_column", "header_rows")).alias("own"))  # the columns of one table
    rows = lambda of: F.flatten(F.filter(F.transform(of, lambda c: c["header_rows"]), lambda r: r.isNotNull()))
    each = lambda col, of: F.struct(col.alias("col"), F.size(of).alias("times"), F.array_min(F.transform(of, lambda c: c["label_column"])).alias("label_column"), rows(of).alias("header_rows"))
    declared = F.transform(F.array_distinct(F.transform("own", lambda c: c["column"])), lambda col: bound(F.filter("own", lambda c: c["column"].eqNullSafe(col)), lambda of: each(col, of)))
    return own.select(*BLOCK, declared.alias("declared"), F.array_compact(F.array_distinct(F.transform("own", lambda c: c["label_column"]))).alias("labels"), F.array_distinct(rows(F.col("own"))).alias("heads"))


def _tables(grid: DataFrame, declared: DataFrame, others: DataFrame) -> DataFrame:
    """Of each table its size, what is declared of its columns, as maps, its columns without amounts, and the rows with a label merged from above."""
    size = grid.groupBy(*BLOCK).agg(F.max("at_row").alias("_rows"), F.max("at_col").alias("_cols"))
    plain = others.where("valid").select(*BLOCK, F.col("column").alias("plain"))
    spans = grid.where("row < at_row").select(*BLOCK, F.struct("at_row", "at_col").alias("span"))
    known = F.filter("declared", lambda d: d["col"].isNotNull())
    of = lambda name: F.map_from_entries(F.transform(known, lambda d: F.struct(d["col"], d[name]))).alias(name)
    found = declared.select(*BLOCK, "labels", "heads", of("label_column"), of("header_rows"))
    for part in (size, plain, spans):
        found = found.unionByName(part, allowMissingColumns=True)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("_rows", "_cols", "labels", "heads", "label_column", "header_rows")]
    found = found.groupBy(*BLOCK).agg(*first, F.collect_set("plain").alias("plain"), F.collect_set("span").alias("spans"))
    merged = F.transform(F.filter("spans", lambda s: _holds("labels", s["at_col"])), lambda s: s["at_row"])
    return found.withColumn("merged", merged).drop("spans")


def claim_audit(cells: DataFrame, grid: DataFrame, columns: DataFrame, others: DataFrame, claims: DataFrame) -> DataFrame:
    """document_id, issue and n: how often each kind of fault occurs in a document's claims.

    Tables as in ``validation.checked_cells``, of ``columns`` only the block, column,
    label_column and header_rows; ``others`` as returned by
    ``non_amount_issues``. Of claims: foreign_model_row (its block is no table),
    model_row_out_of_bounds, model_cell_out_of_bounds (a value beyond the last column;
    a row counts once). Of metadata: duplicate_metadata_column, label_column_is_value_column.
    Of cells: unmapped_numeric_column (columns with numbers that nothing declares),
    numeric_data_declared_header, unreadable_numeric_cell, unextracted_numeric_cells:
    numbers as in ``validation.numeric_census``. Documents without a fault give no rows.
    """
    read = cells.where(F.trim("text") != "").withColumn("_q", compact_quote(F.col("text"))).withColumn("_number", quoted_number(F.col("_q")).isNotNull())
    year, top = F.col("_q").rlike("^(?:19|20)[0-9]{2}$"), F.coalesce((F.col("row") == 1) | F.col("is_header"), F.lit(True))
    bits = _flag(F.col("_number"), NUMBER) + _flag(year, YEAR) + _flag(year & top, TOP_YEAR) + _flag(~F.col("_number") & ~F.trim("text").isin(BLANK_SOURCE), UNREADABLE)
    last = F.array_max(F.transform("values", lambda v: v["column"]))
    data = ~F.coalesce(F.col("role").isin("header", "section"), F.lit(False))
    said = claims.select(*BLOCK, "row", last.alias("col"), (F.lit(CLAIM) + _flag(data, DATA_CLAIM)).alias("bits"))
    # no text is shuffled, and all of a table goes to one place, where it meets what is declared of it
    found = read.select(*BLOCK, "row", "col", bits.alias("bits")).unionByName(said).repartition(*BLOCK)
    declared = _declared(columns)
    found = found.join(_tables(grid, declared, others), BLOCK, "left")

    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    label, headers = F.try_element_at("label_column", F.col("col")), F.try_element_at("header_rows", F.col("col"))
    head = _holds("heads", F.col("row"))
    number = has(NUMBER) & ~_holds("plain", F.col("col")) & ~(head & (has(TOP_YEAR) | (has(YEAR) & _holds("merged", F.col("row")))))
    body = F.coalesce(~F.array_contains(headers, F.col("row")), F.lit(False))
    foreign, below = F.col("_rows").isNull(), F.coalesce(F.col("row") > F.col("_rows"), F.lit(False))
    # a cell stands with the label that its row has by its column's declaration, and once more as a label itself; a claim with every label of its row
    places = F.when(has(CLAIM), F.col("labels")).when(_holds("labels", F.col("col")), F.array(label, F.col("col"))).otherwise(F.array(label))
    cell, claim = ~has(CLAIM), has(CLAIM)
    found = found.select(
        *BLOCK, "row", F.when(cell & number & headers.isNull(), F.col("col")).alias("_free"), (cell & number).alias("_number"), (cell & number & head).alias("_hidden"), (cell & number & body).alias("_body"), (cell & body & has(UNREADABLE)).alias("_unreadable"),
        cell.alias("_cell"), has(DATA_CLAIM).alias("_told"), (claim & foreign).alias("_foreign"), (claim & ~foreign & below).alias("_below"), (claim & ~foreign & ~below & (F.col("col") > F.col("_cols"))).alias("_beside"), F.posexplode_outer(places).alias("_at", "_label"),
    )
    once = F.coalesce(F.col("_at") == 0, F.lit(True))
    rows = found.groupBy(*BLOCK, "row", "_label", F.when(once, F.col("_free")).alias("_free")).agg(
        *[F.count_if(once & F.col(c)).alias(c) for c in ("_number", "_hidden", "_body", "_unreadable", "_foreign", "_below", "_beside")], F.count_if(F.col("_cell") & ~once).alias("_names"), F.count_if("_told").alias("_told")
    )
    counts = {
        "foreign_model_row": F.col("_foreign"), "model_row_out_of_bounds": F.col("_below"), "model_cell_out_of_bounds": F.col("_beside"), "numeric_data_declared_header": F.col("_hidden"),
        "unreadable_numeric_cell": F.col("_unreadable") * F.col("_names"), "unextracted_numeric_cells": F.col("_number") - F.when((F.col("_told") > 0) & (F.col("_names") > 0), F.col("_body")).otherwise(0),
    }
    of_columns = rows.groupBy(*BLOCK, "_free").agg(*[F.sum(n).alias(issue) for issue, n in counts.items()]).withColumn("unmapped_numeric_column", F.col("_free").isNotNull().cast("long"))
    names = F.array_compact(F.transform("declared", lambda d: d["col"]))
    of_metadata = {"duplicate_metadata_column": F.size(F.filter("declared", lambda d: d["times"] > 1)), "label_column_is_value_column": F.size(F.array_intersect("labels", names))}
    whole = of_columns.drop("block_id", "_free").unionByName(declared.select("document_id", *[n.cast("long").alias(issue) for issue, n in of_metadata.items()]), allowMissingColumns=True)
    issues = [*counts, "unmapped_numeric_column", *of_metadata]
    each = whole.groupBy("document_id").agg(*[F.sum(issue).alias(issue) for issue in issues])
    return each.select("document_id", F.inline(F.array(*[F.struct(F.lit(issue).alias("issue"), F.col(issue).alias("n")) for issue in issues]))).where("n > 0")
