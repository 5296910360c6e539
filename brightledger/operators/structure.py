"""HTML tables read tag by tag: an automaton over exploded tags, whose states are running sums and last values.

The depth of nested tables is a sum of steps that doesn't fall below zero; a cell is open
when the last tag that opens or ends one, at depth 1, opened it. So a table needn't be
well formed, and every deviation is an issue of the table that it is found in.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .documents import placed

#: Tags that make up a table, and what isn't read for tags at all. Fixed values.
TAG = r"""(?i)<(/?)(table|tr|td|th)\b((?:[^>"']|"[^"]*"|'[^']*')*)>"""
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
WIDEST = 1000


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Text with all named and numeric character references decoded."""
    return text.map(html.unescape, na_action="ignore")


def piece_text(piece: Column) -> Column:
    """What a piece of a cell says: line breaks kept, other tags dropped."""
    return F.regexp_replace(F.regexp_replace(piece, r"(?i)<br\b[^>]*>", "\n"), "<[^>]*>", "")


def tag_events(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Every tag of the tables in ``body``: keys, at, name, closing, attributes, after, depth, table, row, and the states of the automaton.

    depth counts the tag itself; own: it opens or ends a row, cell or table at depth 1;
    begins: it opens a cell; unclosed: it ends a cell that has no end tag; rowless: it
    opens the first cell of a table before any row; live: a cell is open behind it.
    """
    body = F.regexp_replace(F.coalesce("body", F.lit("")), HIDDEN, "")
    tags, texts = F.regexp_extract_all("_b", F.lit(TAG), F.lit(0)), F.split("_b", TAG)
    cut = parts.select(*keys, body.alias("_b")).select(*keys, F.posexplode(F.arrays_zip(tags.alias("tag"), F.slice(texts, F.lit(2), F.size(tags)).alias("after"))).alias("at", "x"))
    group = lambda n: F.regexp_extract("x.tag", TAG, n)
    rows = cut.select(*keys, "at", F.lower(group(2)).alias("name"), (group(1) == "/").alias("closing"), group(3).alias("attributes"), F.coalesce("x.after", F.lit("")).alias("after"))

    ordered = W.partitionBy(*keys).orderBy("at")
    is_table, is_cell = F.col("name") == "table", F.col("name").isin("td", "th")
    rows = rows.withColumn("_raw", F.sum(F.when(~is_table, 0).when(F.col("closing"), -1).otherwise(1)).over(ordered))
    rows = rows.withColumn("depth", F.col("_raw") - F.least(F.lit(0), F.min("_raw").over(ordered)))
    level = F.col("depth") == 1
    rows = rows.withColumn("opens", is_table & ~F.col("closing") & level).withColumn("table", F.count_if("opens").over(ordered)).where("table > 0")
    rows = rows.withColumn("begins", is_cell & ~F.col("closing") & level).withColumn("own", (~is_table & level) | (is_table & F.col("closing") & (F.col("depth") == 0)))
    state = F.when(F.col("own"), F.col("begins"))
    was = F.coalesce(F.last(state, ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    live = F.coalesce(F.last(state, ignorenulls=True).over(ordered), F.lit(False))
    within = W.partitionBy(*keys, "table").orderBy("at")
    lines = F.count_if((F.col("name") == "tr") & ~F.col("closing") & level).over(within)
    end = F.lead("at").over(ordered).isNull()
    rows = rows.withColumn("live", live).withColumn("_lines", lines).withColumn("rowless", F.col("begins") & (F.col("_lines") == 0))
    return rows.select(
        *keys, "at", "name", "closing", "attributes", "after", "depth", "table", "opens", "own", "begins", "live",
        (F.col("rowless") & ~F.coalesce(F.max("rowless").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))).alias("rowless"),
        (F.col("_lines") + F.max("rowless").over(within).cast("int")).alias("row"), (F.col("own") & was & ~(is_cell & F.col("closing"))).alias("unclosed"), (end & F.col("live")).alias("open_end"),
        (is_table & ~F.col("closing") & (F.col("depth") > 1)).alias("nested"), (end & (F.col("depth") > 0)).alias("open_table"),
    )


def span_of(name: str) -> tuple[Column, Column]:
    """The span that an attribute says, and whether what it says is no number from 1 to WIDEST (then 1 counts)."""
    quoted = F.regexp_extract("attributes", rf"""(?i)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    said = F.regexp_replace(quoted, "^[\"']|[\"']$", "")
    number = F.when(said.rlike("^[0-9]{1,6}$"), said.cast("int"))
    fine = number.between(1, WIDEST)
    return F.when(said == "", 1).when(fine, number).otherwise(1), (said != "") & ~F.coalesce(fine, F.lit(False))


def structure_issues(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table, issue and n of what deviates in the tables of ``tag_events``: a row for each kind of issue of a table."""
    kinds = {
        "nested_table": F.col("nested"), "unclosed_cell": F.col("unclosed") | F.col("open_end"), "cell_without_row": F.col("rowless"), "unclosed_table": F.col("open_table"),
        **{f"invalid_{name}": F.col("begins") & span_of(name)[1] for name in ("rowspan", "colspan")},
    }
    counts = events.groupBy(*keys, "table").agg(*[F.count_if(c).alias(kind) for kind, c in kinds.items()])
    pairs = F.array(*[F.struct(F.lit(kind).alias("issue"), F.col(kind).alias("n")) for kind in kinds])
    return counts.select(*keys, "table", F.inline(F.filter(pairs, lambda p: p["n"] > 0)))


def structured_cells(events: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of the tables of ``tag_events``: keys, table, row, col, rowspan, colspan, is_header and text.

    A cell reaches to its end tag, or to whatever else ends it; what nested tables hold
    isn't part of it. Columns that are spanned from above are passed over.
    """
    ordered = W.partitionBy(*keys).orderBy("at")
    told = events.withColumn("cell", F.count_if("begins").over(ordered)).where(F.col("live") & (F.col("depth") == 1))
    (down, _), (right, _) = span_of("rowspan"), span_of("colspan")
    first = lambda c: F.max(F.when(F.col("begins"), c))
    found = told.groupBy(*keys, "table", "cell").agg(
        first(F.col("row")).alias("row"), first(down).alias("rowspan"), first(right).alias("colspan"), first(F.col("name") == "th").alias("is_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "after"))), lambda p: p["after"]), "").alias("body"),
    )
    text = piece_text(F.col("body"))
    found = found.withColumn("text", F.regexp_replace(F.when(text.contains("&"), unescaped(text)).otherwise(text), r"(?U)^\s+|\s+$", "")).drop("body")
    rows = found.groupBy(*keys, "table", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "rowspan", "colspan", "is_header", "text"))).alias("cells"))
    spans = F.struct(F.col("row"), F.transform("cells", lambda c: F.array(c["rowspan"], c["colspan"])).alias("spans"))
    tables = rows.groupBy(*keys, "table").agg(F.array_sort(F.collect_list(F.struct(F.col("row"), F.col("cells"), spans.alias("spans")))).alias("rows"))
    tables = tables.withColumn("cols", placed.asNondeterministic()(F.transform("rows", lambda r: r["spans"])))
    each = tables.select(*keys, "table", F.explode(F.arrays_zip("rows", "cols")).alias("x")).select(*keys, "table", F.col("x.rows.row").alias("row"), F.inline(F.arrays_zip(F.col("x.rows.cells").alias("c"), F.col("x.cols").alias("at"))))
    return each.select(*keys, "table", "row", (F.col("at") + 1).alias("col"), "c.rowspan", "c.colspan", "c.is_header", "c.text")
