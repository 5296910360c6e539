"""The checking of a reader's claims, over tables written from orders: one of a statement's for each customer.

A row is an order: its amount, blank where the order's number is divisible by 5, and a
figure of the year before, unreadable for odd numbers. The reader misreads every
seventh order and leaves out every eleventh; of odd customers the earlier year isn't proven.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import audit, exports, merging, validation
from ..sources.readers import table
from .registry import query

DOUBLE = "double"
_BASE = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, o_custkey AS k, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS row_no, CAST(o_totalprice AS DECIMAL(18,2)) AS v,
   max(year(o_orderdate)) OVER (PARTITION BY o_custkey) + 20 AS y FROM orders),
 x AS (SELECT *, 3 AS col_no, CASE WHEN ok % 5 <> 0 THEN v END AS amount, ok % 5 = 0 AS blank, false AS odd, false AS unproven, ok % 7 = 0 AS wrong, y || '-12-31' AS period FROM o
  UNION ALL SELECT *, 4, CASE WHEN ok % 2 = 0 THEN ok % 100 END, false, ok % 2 <> 0, k % 2 <> 0, false, (y - 1) || '-12-31' FROM o),
 s AS (SELECT *, list_filter([CASE WHEN unproven THEN 'period_evidence_missing' END, CASE WHEN wrong THEN 'source_value_mismatch' END, CASE WHEN blank THEN 'source_blank' END, CASE WHEN odd THEN 'source_number_unreadable' END], lambda i: i IS NOT NULL) AS found,
   CASE row_no WHEN 2 THEN 'cash' WHEN 3 THEN 'inventory' END AS concept FROM x),
 c AS (SELECT *, CASE WHEN ok % 11 = 0 THEN CASE WHEN amount IS NOT NULL THEN 'MISSING' END WHEN wrong THEN 'CONFLICT' WHEN len(found) > 0 THEN 'GAP' WHEN concept IS NULL THEN 'UNMAPPED' ELSE 'VERIFIED' END AS state FROM s)"""


def _declared(spark, d):
    """cells, grid, declared columns, declared other columns and claims."""
    key, doc = F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("document_id")
    orders = table(spark, d, "orders").select("o_custkey", doc, F.col("o_custkey").alias("k"), key.alias("ok"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    own = table(spark, d, "orders").groupBy("o_custkey").agg((F.max(F.year("o_orderdate")) + 20).alias("y"))
    day = lambda y: F.concat(y.cast("string"), F.lit("年12月31日"))
    lines = orders.withColumn("row", F.row_number().over(W.partitionBy("o_custkey").orderBy("ok", "v")) + 1)
    label, amount = F.concat(F.lit("项目"), F.col("ok").cast("string")), F.when(F.col("ok") % 5 != 0, F.format_number("v", 2))
    earlier = F.when(F.col("ok") % 2 == 0, (F.col("ok") % 100).cast("string"))
    # a text is told by its column, so that it is made only where it is read
    put = lambda rows, texts, head: rows.withColumn("col", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).select("document_id", F.lit("b").alias("block_id"), "row", "col", F.lit(head).alias("is_header"), F.coalesce(*[F.when(F.col("col") == n, t) for n, t in enumerate(texts, 1)]).alias("text"))
    body = put(lines, [label, (F.col("ok") % 9).cast("string"), F.coalesce(amount, F.lit("—")), F.coalesce(earlier, F.lit("x"))], False)
    head = put(own.select(doc, F.lit(1).alias("row"), "y"), [F.lit("项目"), F.lit("附注"), day(F.col("y")), day(F.col("y") - 1)], True)
    cells = body.unionByName(head)
    grid = cells.select("document_id", "block_id", F.col("row").alias("at_row"), F.col("col").alias("at_col"), "row", "col", "text")

    said = {"entity": "编制单位：甲公司", "scope": "合并资产负债表", "unit": "单位：人民币万元", "currency": "人民币", "statement_type": "资产负债表"}
    proofs = lambda y, shown: F.map_filter(F.create_map(*[F.lit(t) for pair in said.items() for t in pair], F.lit("period"), F.when(shown, day(y))), lambda _, v: v.isNotNull())
    column = lambda at, y, shown: F.struct(F.lit(at).alias("column"), day(y).alias("raw_header"), F.concat(y.cast("string"), F.lit("-12-31")).alias("period"), proofs(y, shown).alias("proofs"))
    columns = own.select(doc, F.lit("b").alias("block_id"), F.inline(F.array(column(3, F.col("y"), F.lit(True)), column(4, F.col("y") - 1, F.col("o_custkey") % 2 == 0)))).select(
        "document_id", "block_id", "column", F.lit(1).alias("label_column"), F.array(F.lit(1)).alias("header_rows"), "raw_header", "period", F.lit(None).cast("string").alias("period_kind"), F.lit("closing").alias("period_basis"), F.lit("balance_sheet").alias("statement_type"),
        F.lit("甲公司").alias("entity"), F.lit("consolidated").alias("scope"), F.lit("CNY").alias("currency"), F.lit("万元").alias("raw_unit"), F.array().cast("array<string>").alias("structure_issues"), "proofs",
    )
    plain = lambda at, proof: F.struct(F.lit(at).alias("column"), F.lit(proof).alias("proof"))
    others = own.select(doc, F.lit("b").alias("block_id"), F.inline(F.when(F.col("o_custkey") % 2 == 0, F.array(plain(2, "附注"), plain(3, ""))).otherwise(F.array(plain(2, "附注")))))
    others = others.select("document_id", "block_id", "column", F.array(F.lit(1)).alias("header_rows"), F.lit("附注").alias("raw_header"), "proof")

    value = lambda at, raw: F.struct(F.lit(at).alias("column"), raw.alias("raw_value"))
    claimed = F.when(F.col("ok") % 7 == 0, "0.5").otherwise(amount)
    claims = lines.where("ok % 11 <> 0").select(
        "document_id", F.lit("b").alias("block_id"), "row", label.alias("source_name"), F.when(F.col("row") == 2, "cash").when(F.col("row") == 3, "inventory").alias("concept"), F.lit("data").alias("role"), F.lit(None).cast("string").alias("raw_unit"), F.array(value(3, claimed), value(4, earlier)).alias("values")
    )
    return cells, grid, columns, others, claims


def _given(spark, d):
    """cells, grid, checked columns, checked other columns and claims."""
    cells, grid, columns, others, claims = _declared(spark, d)
    return cells, grid, validation.metadata_issues(columns, grid), validation.non_amount_issues(others, columns, grid), claims


@query("WITH " + _BASE + """, d AS (SELECT DISTINCT document_id, k, y FROM o) SELECT document_id, unnest([3, 4]) AS column_no, unnest([y || '-12-31', (y - 1) || '-12-31']) AS period, 'instant' AS kind, unnest(['', CASE WHEN k % 2 <> 0 THEN 'period_evidence_missing' ELSE '' END]) AS issues FROM d""")
def metadata_issues(spark, d):
    return _given(spark, d)[2].select("document_id", F.col("column").alias("column_no"), F.col("period_found").alias("period"), F.col("kind_found").alias("kind"), F.array_join("issues", ",").alias("issues"))


@query("WITH " + _BASE + """, d AS (SELECT DISTINCT document_id, k FROM o) SELECT document_id, 2 AS column_no, true AS valid, '' AS issues FROM d UNION ALL SELECT document_id, 3, false, 'non_amount_column_overlap,non_amount_header_mismatch,non_amount_evidence_missing' FROM d WHERE k % 2 = 0""")
def non_amount_columns(spark, d):
    return _given(spark, d)[3].select("document_id", F.col("column").alias("column_no"), "valid", F.array_join("issues", ",").alias("issues"))


@query("WITH " + _BASE + " SELECT document_id, row_no, col_no, amount FROM (SELECT document_id, CAST(row_no AS INTEGER) AS row_no, col_no, CAST(amount AS DOUBLE) AS amount FROM x) WHERE amount IS NOT NULL")
def numeric_census(spark, d):
    cells, grid, columns, others, _ = _given(spark, d)
    found = validation.numeric_census(cells, grid, columns, others)
    return found.select("document_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.replace("text", F.lit(","), F.lit("")).cast(DOUBLE).alias("amount"))


@query("WITH " + _BASE + """ SELECT document_id, CAST(row_no AS INTEGER) AS row_no, col_no, state, CASE WHEN state IN ('VERIFIED', 'UNMAPPED') THEN CAST(amount * 10000 AS DOUBLE) END AS value,
 CASE state WHEN 'VERIFIED' THEN 'source_verified' WHEN 'CONFLICT' THEN 'pending_confirmation' WHEN 'UNMAPPED' THEN 'pending_confirmation' WHEN 'GAP' THEN 'source_value_not_found' END AS status, CASE WHEN state = 'MISSING' THEN '' ELSE array_to_string(found, ',') END AS issues FROM c WHERE state IS NOT NULL""")
def table_validation(spark, d):
    cells, _, columns, _, claims = _given(spark, d)
    found = validation.checked_cells(cells, columns, claims)
    return found.select("document_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), "state", F.col("value").cast(DOUBLE).alias("value"), "status", F.array_join("issues", ",").alias("issues"))


@query("WITH " + _BASE + " SELECT document_id, CAST(row_no AS INTEGER) AS row_no, col_no, CASE WHEN row_no = 2 AND col_no = 3 AND k % 3 <> 0 THEN 'local_disagreement' ELSE '' END AS issues FROM c WHERE state = 'VERIFIED'")
def second_opinion(spark, d):
    """Another reader of each customer's first order: it disagrees for two customers of three, and supplies nothing."""
    cells, _, columns, _, claims = _given(spark, d)
    lines = cells.where("row = 2").groupBy("document_id").agg(F.max(F.when(F.col("col") == 1, F.col("text"))).alias("source_name"), F.max(F.when(F.col("col") == 3, F.col("text"))).alias("raw"))
    own = lines.join(columns.where("column = 3").select("document_id", F.col("period_found").alias("period")), "document_id")
    value = (F.replace("raw", F.lit(","), F.lit("")).try_cast("decimal(18,2)") * 10000).cast("decimal(28,8)")
    value = F.when(F.col("document_id").cast("long") % 3 == 0, value).otherwise(F.lit(-1).cast("decimal(28,8)"))
    second = own.select("document_id", F.lit(2).alias("line"), "source_name", "period", F.lit("cash").alias("concept"), value.alias("value"), F.lit("consolidated").alias("scope"), F.lit("甲公司").alias("entity"), F.lit("CNY").alias("currency"))
    found = validation.checked_cells(cells.withColumn("line", F.col("row")), columns, claims, second).where("state = 'VERIFIED'")
    return found.select("document_id", F.col("row").alias("row_no"), F.col("col").alias("col_no"), F.array_join("issues", ",").alias("issues"))


@query("WITH " + _BASE + """ SELECT document_id, count(amount) AS numeric_cells, count(amount) FILTER (ok % 11 <> 0) AS extracted, count(amount) FILTER (ok % 11 = 0) AS missing, count(*) FILTER (blank AND ok % 11 <> 0) AS blank,
 count(*) FILTER (odd AND ok % 11 <> 0) AS unreadable, 'total_assets,total_equity,total_liabilities' AS core, 'partial' AS status FROM c GROUP BY 1 HAVING count(amount) > 0""")
def table_coverage(spark, d):
    cells, grid, columns, others, claims = _given(spark, d)
    found = validation.table_coverage(cells, validation.numeric_census(cells, grid, columns, others), validation.checked_cells(cells, columns, claims))
    return found.select("document_id", "numeric_cells", F.col("extracted_cells").alias("extracted"), F.col("missing_numeric_cells").alias("missing"), F.col("blank_cells").alias("blank"), F.col("unreadable_cells").alias("unreadable"), F.array_join("missing_core", ",").alias("core"), "status")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'header_missing,x' || o_orderstatus ELSE '' END AS reasons, o_orderkey % 3 <> 0 AS review FROM orders""")
def review_reasons(spark, d):
    key = F.col("o_orderkey") % 3
    issues = F.when(key == 0, F.array(F.lit("source_blank"), F.concat(F.lit("missing_core:"), "o_orderstatus"))).when(key == 1, F.array(F.concat(F.lit("x"), "o_orderstatus"), F.lit("header_missing"), F.lit("header_missing"))).otherwise(F.array().cast("array<string>"))
    checks = F.when(key == 2, F.array(F.lit("conflict"))).otherwise(F.array(F.lit("passed")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(validation.review_reasons(issues), ",").alias("reasons"), validation.should_review(issues, checks).alias("review"))


@query("""SELECT c_custkey, fault FROM customer JOIN (VALUES (1, 'question_coverage'), (1, 'unknown_block'), (1, 'unbound_block'), (1, 'question_metric_binding_missing'), (1, 'unknown_metric_ref'), (1, 'unbound_number_or_unverified_claim'), (2, 'missing_metric_marked_answered')) AS v(kind, fault) ON c_custkey % 3 = kind""")
def draft_validation(spark, d):
    """A draft of each customer: sound, with a number of its own and wrong references, or with an answer on a missing metric."""
    of = list(validation.QUESTIONS.items())
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("draft_id"), (F.col("c_custkey") % 3).alias("kind"))
    rows = lambda given, columns: F.broadcast(spark.createDataFrame(given, columns))  # noqa: E731  a form of a draft: some rows
    segments = [(x, f"P{i}", k, t, r) for x in (0, 2) for i, (_, c) in enumerate(of) for k, t, r in (("text", "负债率：", None), ("metric", None, c))] + [(1, "P0", "text", "第1项", None), (1, "P1", "metric", None, "other")]
    answers = [(x, q, "answered", [f"P{i}"]) for x in (0, 2) for i, (q, _) in enumerate(of)] + [(1, "Q001", "gap", ["P0", "P9"])]
    metrics = [(x, c, None if x == 2 and c == "quick_ratio" else "1") for x in (0, 1, 2) for _, c in of]
    put = lambda given, columns: customers.join(rows(given, f"kind int, {columns}"), "kind").drop("kind")
    found = validation.draft_faults(put(segments, "block_id string, kind_ string, text string, ref string").withColumnRenamed("kind_", "kind"), put(answers, "question_id string, status string, block_ids array<string>"), put(metrics, "code string, value string"))
    return found.select(F.col("draft_id").cast("long").alias("c_custkey"), "fault")


# Packing and exports -------------------------------------------------------------


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS n FROM lineitem),
 r(k, n, part, held) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), 1, CAST(15 AS BIGINT) FROM l UNION ALL
  SELECT l.k, l.n, CASE WHEN held + size > 90 AND held > 15 THEN part + 1 ELSE part END, CASE WHEN held + size > 90 AND held > 15 THEN 15 + size ELSE held + size END FROM r JOIN l ON l.k = r.k AND l.n = r.n + 1)
 SELECT k AS l_orderkey, part, min(n) + 1 AS first_row, max(n) + 1 AS last_row, max(held) AS size, max(held) <= 90 AS fits FROM r WHERE n > 0 GROUP BY 1, 2""")
def packed_rows(spark, d):
    """Order lines in parts of at most 90, each with the order's header row again."""
    line = F.struct("l_linenumber", "l_quantity", "l_extendedprice")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = lines.select("l_orderkey", F.posexplode("lines").alias("n", "x")).select("l_orderkey", (F.col("n") + 2).cast("long").alias("row"), F.col("x.l_quantity").cast("long").alias("size"), F.lit(False).alias("header"))
    heads = lines.select("l_orderkey", F.lit(1).cast("long").alias("row"), F.lit(15).cast("long").alias("size"), F.lit(True).alias("header"))
    return merging.packed_rows(body.unionByName(heads), ["l_orderkey"], 90)


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' THEN count(*) FILTER (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) END AS serial FROM orders""")
def export_serials(spark, d):
    """Orders numbered across their priorities: pending ones are hidden, those of low priority head a section."""
    shown, section = F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "5-LOW"
    return exports.serial_numbers(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")], shown, section).select("o_custkey", "o_orderkey", "serial")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'percent' ELSE 'text' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN '#,##0.00' WHEN 1 THEN '0.00%' ELSE '@' END AS format FROM lineitem""")
def export_formats(spark, d):
    shown = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    raw = F.when(F.col("l_linenumber") % 4 == 0, shown).when(F.col("l_linenumber") % 4 == 1, F.concat(shown, F.lit(" %"))).when(F.col("l_linenumber") % 4 == 2, F.concat(shown, F.lit("00000000001234"))).otherwise(F.concat(F.lit("第"), shown))
    kind, form = exports.cell_format(raw, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), form.alias("format"))


@query("WITH " + _BASE + """, d AS (SELECT document_id, k, count(*) AS rows, count(*) FILTER (ok % 11 = 0 AND ok % 5 <> 0) + count(*) FILTER (ok % 11 = 0 AND ok % 2 = 0) AS lost, count(*) FILTER (ok % 2 <> 0) AS odd FROM o GROUP BY 1, 2),
 i AS (SELECT document_id, CASE k % 5 WHEN 0 THEN 'foreign_model_row' WHEN 1 THEN 'model_row_out_of_bounds' WHEN 2 THEN 'model_cell_out_of_bounds' WHEN 3 THEN 'duplicate_metadata_column' ELSE 'label_column_is_value_column' END AS issue, 1 AS n FROM d
  UNION ALL SELECT document_id, 'unmapped_numeric_column', 1 FROM d WHERE k % 7 = 0 UNION ALL SELECT document_id, 'unreadable_numeric_cell', odd FROM d
  UNION ALL SELECT document_id, 'unextracted_numeric_cells', lost + CASE WHEN k % 7 = 0 THEN rows ELSE 0 END FROM d)
 SELECT * FROM i WHERE n > 0""")
def claim_audit(spark, d):
    """Faults of the claims as such: each customer has one of five, every seventh a column that nothing declares."""
    cells, grid, columns, others, claims = _declared(spark, d)
    others = validation.non_amount_issues(others, columns, grid)
    k = F.col("document_id").cast("long")
    whole = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document_id")).distinct().where(k % 5 < 3)
    value = F.array(F.struct(F.when(k % 5 == 2, 9).otherwise(3).alias("column"), F.lit("1").alias("raw_value")))
    extra = whole.select("document_id", F.when(k % 5 == 0, "z").otherwise("b").alias("block_id"), F.when(k % 5 == 1, 999_999).otherwise(1).alias("row"), F.lit("x").alias("source_name"), F.lit(None).cast("string").alias("concept"), F.lit("header").alias("role"), F.lit(None).cast("string").alias("raw_unit"), value.alias("values"))
    more = columns.unionByName(columns.where((k % 5 == 3) & (F.col("column") == 3))).withColumn("label_column", F.when((k % 5 == 4) & (F.col("column") == 4), 3).otherwise(F.col("label_column")))
    return audit.claim_audit(cells, grid, more, others.where(k % 7 != 0), claims.unionByName(extra))
