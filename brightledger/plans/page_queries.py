"""Queries of structure over the table pages: their lists and paragraphs read as tables, which they have none of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import structure as S
from ..sources.readers import table
from .registry import query

#: What tags of a page are read as: paragraphs without an end tag make cells that stay open, bold words cells in cells.
_READ = [(r"<(/?)(?:article|ul)\b", "<{1}table"), (r"<h1\b", '<tr><th colspan="2"'), (r"</h1\b", "</th"), (r"<(/?)(?:p|li)\b", "<{1}td"), (r"<b\b", '<th rowspan="0"'), (r"</b\b", "</th"), (r"<nav\b", "<table"), (r"</nav\b", "</table")]


#: As above, with bold words that claim to reach over three rows.
_DEEP = [(form, read.replace('rowspan="0"', 'rowspan="3"')) for form, read in _READ]


def _pages(spark, d, reads=_READ):
    html = F.col("html")
    for form, read in reads:
        html = F.regexp_replace(html, form, read.replace("{1}", "$1"))
    return table(spark, d, "pages").select("page_id", html.alias("body"))


def _events(spark, d, reads=_READ):
    return S.tag_events(_pages(spark, d, reads), ["page_id"])


def _sql(reads=_READ) -> str:
    html = "html"
    for form, read in reads:
        html = "regexp_replace({}, '{}', '{}', 'g')".format(html, form, read.replace("{1}", "\\1"))
    tag, hidden = S.TAG.replace("'", "''"), S.HIDDEN.replace("'", "''")
    tail = "OVER (PARTITION BY page_id ORDER BY at_)"
    before = "OVER (PARTITION BY page_id ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inside = "OVER (PARTITION BY page_id, tbl ORDER BY at_)"
    said = "regexp_replace(regexp_extract(attributes, '(?i)(?:^|\\s){0}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)', 1), '^[\"'']|[\"'']$', '', 'g') AS {0}_said"
    return f"""b AS (SELECT page_id, regexp_replace({html}, '{hidden}', '', 'g') AS body FROM pages),
 t AS (SELECT page_id, unnest(regexp_extract_all(body, '{tag}')) AS tag, unnest(regexp_extract_all(body, '{tag}', 1)) AS slash, unnest(regexp_extract_all(body, '{tag}', 2)) AS name, unnest(regexp_extract_all(body, '{tag}', 3)) AS attributes,
   unnest(string_split_regex(body, '{tag}')[2:]) AS after, unnest(range(len(regexp_extract_all(body, '{tag}')))) AS at_ FROM b),
 r AS (SELECT *, slash = '/' AS closing, sum(CASE WHEN name <> 'table' THEN 0 WHEN slash = '/' THEN -1 ELSE 1 END) {tail} AS raw FROM t),
 e0 AS (SELECT *, raw - least(0, min(raw) {tail}) AS depth FROM r),
 e1 AS (SELECT *, count(*) FILTER (name = 'table' AND NOT closing AND depth = 1) {tail} AS tbl, name IN ('td', 'th') AND NOT closing AND depth = 1 AS begins,
   (name <> 'table' AND depth = 1) OR (name = 'table' AND closing AND depth = 0) AS own FROM e0),
 e2 AS (SELECT *, coalesce(last_value(CASE WHEN own THEN begins END IGNORE NULLS) {before}, false) AS was, coalesce(last_value(CASE WHEN own THEN begins END IGNORE NULLS) {tail}, false) AS live,
   count(*) FILTER (name = 'tr' AND NOT closing AND depth = 1) {inside} AS lines, lead(at_) {tail} IS NULL AS last_one FROM e1 WHERE tbl > 0),
 e3 AS (SELECT *, begins AND lines = 0 AS early, count(*) FILTER (begins) {tail} AS cell, {said.format('rowspan')}, {said.format('colspan')} FROM e2),
 e AS (SELECT *, lines + max(CASE WHEN early THEN 1 ELSE 0 END) {inside} AS row_no, own AND was AND NOT (name IN ('td', 'th') AND closing) AS unclosed,
   CASE WHEN try_cast(rowspan_said AS INTEGER) BETWEEN 1 AND 1000 THEN CAST(rowspan_said AS INTEGER) ELSE 1 END AS rowspan, CASE WHEN try_cast(colspan_said AS INTEGER) BETWEEN 1 AND 1000 THEN CAST(colspan_said AS INTEGER) ELSE 1 END AS colspan FROM e3),
 c AS (SELECT page_id, tbl, cell, max(row_no) FILTER (begins) AS row_no, max(rowspan) FILTER (begins) AS rowspan, max(colspan) FILTER (begins) AS colspan, bool_or(begins AND name = 'th') AS is_header,
   trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(string_agg(after, '' ORDER BY at_), '(?i)<br\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS text
   FROM e WHERE live AND depth = 1 GROUP BY 1, 2, 3)"""


@query("WITH " + _sql() + """ SELECT page_id, tbl AS table_no, issue, n FROM (
 SELECT page_id, tbl, unnest(['nested_table', 'unclosed_cell', 'cell_without_row', 'unclosed_table', 'invalid_rowspan', 'invalid_colspan']) AS issue,
  unnest([count(*) FILTER (name = 'table' AND NOT closing AND depth > 1), count(*) FILTER (unclosed OR (last_one AND live)), max(CASE WHEN early THEN 1 ELSE 0 END), count(*) FILTER (last_one AND depth > 0),
   count(*) FILTER (begins AND rowspan_said <> '' AND coalesce(try_cast(rowspan_said AS INTEGER), 0) NOT BETWEEN 1 AND 1000), count(*) FILTER (begins AND colspan_said <> '' AND coalesce(try_cast(colspan_said AS INTEGER), 0) NOT BETWEEN 1 AND 1000)]) AS n FROM e GROUP BY 1, 2) WHERE n > 0""")
def page_structure_issues(spark, d):
    return S.structure_issues(_events(spark, d), ["page_id"]).select("page_id", F.col("table").alias("table_no"), "issue", "n")


@query("WITH " + _sql() + " SELECT page_id, tbl AS table_no, row_no, rowspan, colspan, is_header, text, row_number() OVER (PARTITION BY page_id, tbl, row_no ORDER BY cell) AS n FROM c")
def page_cells(spark, d):
    found = S.structured_cells(_events(spark, d), ["page_id"])
    place = F.expr("row_number() OVER (PARTITION BY page_id, table, row ORDER BY col)")
    return found.select("page_id", F.col("table").alias("table_no"), F.col("row").alias("row_no"), "rowspan", "colspan", "is_header", "text", place.cast("long").alias("n"))


@query("WITH " + _sql() + """, w AS (SELECT *, coalesce(sum(colspan) OVER (PARTITION BY page_id, tbl, row_no ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM c)
 SELECT page_id, tbl AS table_no, max(row_no) AS height, max(col + colspan - 1) AS width, CAST(sum(colspan) AS BIGINT) AS covered, count(DISTINCT CASE WHEN colspan > 1 THEN cell END) AS merged FROM w GROUP BY 1, 2""")
def page_grids(spark, d):
    """Dense grids of the tables: places covered, and cells that cover several. No cell of theirs reaches over several rows."""
    dense = D.grid(S.structured_cells(_events(spark, d), ["page_id"]), ["page_id"])
    merged = dense.groupBy("page_id", "table", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    own = dense.groupBy("page_id", "table").agg(F.max("at_row").alias("height"), F.max("at_col").alias("width"), F.count(F.lit(1)).alias("covered"))
    return own.join(merged.groupBy("page_id", "table").agg(F.count_if(F.col("n") > 1).alias("merged")), ["page_id", "table"]).withColumnRenamed("table", "table_no")


_PLACED = """, w AS (SELECT *, coalesce(sum(colspan) OVER (PARTITION BY page_id, tbl, row_no ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM c)"""


@query("WITH " + _sql() + _PLACED + " SELECT page_id, tbl AS table_no, row_no AS at_row, CAST(col + unnest(range(colspan)) AS BIGINT) AS at_col, row_no AS row, CAST(col AS BIGINT) AS col, text FROM w")
def html_table_grid(spark, d):
    dense = D.grid(S.structured_cells(_events(spark, d), ["page_id"]), ["page_id"])
    return dense.select("page_id", F.col("table").alias("table_no"), "at_row", F.col("at_col").cast("long").alias("at_col"), "row", F.col("col").cast("long").alias("col"), "text")


@query("WITH " + _sql() + _PLACED + """, k AS (SELECT DISTINCT page_id, tbl FROM w)
 SELECT k.page_id, k.tbl AS table_no, a.at_row, a.at_col, w.text, CASE WHEN a.at_row < 1 THEN 'invalid_cell_coordinate' WHEN w.text IS NULL THEN 'cell_not_found' END AS fault
 FROM k CROSS JOIN (VALUES (1, 1), (1, 2), (0, 1), (9, 1)) AS a(at_row, at_col) LEFT JOIN w ON w.page_id = k.page_id AND w.tbl = k.tbl AND w.row_no = a.at_row AND a.at_col BETWEEN w.col AND w.col + w.colspan - 1""")
def cell_resolve(spark, d):
    dense = D.grid(S.structured_cells(_events(spark, d), ["page_id"]), ["page_id"])
    places = F.array(*[F.struct(F.lit(y).alias("at_row"), F.lit(x).alias("at_col")) for y, x in ((1, 1), (1, 2), (0, 1), (9, 1))])
    asked = dense.select("page_id", "table").distinct().select("page_id", "table", F.inline(places))
    return D.resolved(asked, dense, ["page_id"]).select("page_id", F.col("table").alias("table_no"), "at_row", "at_col", "text", "fault")


@query("WITH " + _sql(_DEEP) + """, h9 AS (SELECT page_id, tbl, max(row_no) AS height, max(row_no + rowspan - 1) AS reach FROM c GROUP BY 1, 2) SELECT page_id, tbl AS table_no, 'rowspan_outside_table' AS issues FROM h9 WHERE reach > height""")
def span_issues(spark, d):
    found = S.structured_cells(_events(spark, d, _DEEP), ["page_id"])
    return D.span_issues(found, ["page_id"]).select("page_id", F.col("table").alias("table_no"), F.array_join("issues", ",").alias("issues"))
