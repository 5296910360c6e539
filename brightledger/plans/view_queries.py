"""Queries of the views: selection, review, orders, roll-ups, records, JSON, scalars of display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..operators import tables, views
from ..sources.readers import table
from .registry import example, query

DOUBLE = "double"
_STATE = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'running' END"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'human_confirmed' WHEN 'O' THEN 'source_verified' ELSE 'human_rejected' END"


def _status():
    return F.when(F.col("o_orderstatus") == "F", "human_confirmed").when(F.col("o_orderstatus") == "O", "source_verified").otherwise("human_rejected")


# Selection and review ------------------------------------------------------------


@query(f"""SELECT project, o_orderkey, state FROM (SELECT o_custkey AS project, o_orderkey, {_STATE} AS state,
 row_number() OVER (PARTITION BY o_custkey ORDER BY ({_STATE}) = 'completed' DESC, o_orderdate DESC, o_orderkey) AS n FROM orders
 WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW') WHERE n = 1""")
def readable_batch(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial").otherwise("running")
    imports = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), "o_orderkey", state.alias("state"), F.col("o_orderdate").alias("completed_at"), "o_orderpriority")
    bound = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return views.readable_batch(imports, "project", F.col("o_orderpriority"), bound, F.col("o_orderkey")).select("project", "o_orderkey", "state")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'")
def supplement_exclusion(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("supplemental"))
    return views.without_supplements(items, ["l_orderkey"])


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE contains(p_brand, '3') OR contains(translate(p_name, '7', '3'), '3'))")
def label_search(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.translate("p_name", "7", "3").alias("named"))
    return views.label_search(parts, ["p_brand"], "p_brand", "named", "3").select("p_partkey", "p_brand")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licens')")
def note_search(spark, d):
    return views.note_search(table(spark, d, "documents"), "LiCenS").select("doc_id")


_CELLS = f"""c AS (SELECT o_custkey, month(o_orderdate) AS m, {_STATUS} AS s, CAST(floor(o_totalprice / 100000) AS BIGINT) AS v FROM orders),
 g AS (SELECT o_custkey, m, count(*) FILTER (s <> 'human_rejected') AS live, count(DISTINCT v) FILTER (s <> 'human_rejected') AS k,
   coalesce(bool_and(s = 'human_confirmed') FILTER (s <> 'human_rejected'), false) AS confirmed, bool_or(s = 'source_verified') AS undecided FROM c GROUP BY 1, 2),
 t AS (SELECT *, CASE WHEN live = 0 THEN 'rejected' WHEN k > 1 THEN 'conflict' WHEN NOT confirmed THEN 'pending' ELSE 'value' END AS state FROM g)"""


def _cells(spark, d):
    cells = table(spark, d, "orders").select("o_custkey", F.month("o_orderdate").alias("m"), _status().alias("status"), F.floor(F.col("o_totalprice") / 100000).alias("value"))
    return views.reviewed_cells(cells, ["o_custkey", "m"])


@query("WITH " + _CELLS + " SELECT o_custkey, m, state FROM t WHERE o_custkey IN (SELECT o_custkey FROM t WHERE state = 'value' AND confirmed)")
def review_filter(spark, d):
    return views.review_filter(_cells(spark, d), ["o_custkey"], "confirmed").select("o_custkey", "m", "state")


@query("WITH " + _CELLS + """ SELECT o_custkey, count(*) FILTER (state = 'conflict') AS conflict, count(*) FILTER (state = 'value' AND confirmed) AS confirmed,
 count(*) FILTER (state IN ('pending', 'conflict') OR undecided) AS unreviewed FROM t GROUP BY 1""")
def review_counts(spark, d):
    return views.review_counts(_cells(spark, d), ["o_custkey"])


@query("""SELECT c_nationkey, count(*) AS projects, count(*) FILTER (c_acctbal < 0) AS stale, count(*) FILTER (c_mktsegment = 'BUILDING') AS current,
 count(*) FILTER (c_custkey % 7 = c_custkey % 5) AS exports_current FROM customer GROUP BY 1""")
def dashboard_counts(spark, d):
    projects = table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") < 0).alias("metrics_stale"), F.when(F.col("c_mktsegment") == "BUILDING", "current").otherwise("draft").alias("section_state"),
                                                  (F.col("c_custkey") % 7).alias("export_hash"), (F.col("c_custkey") % 5).alias("section_hash"))
    return views.dashboard(projects, "c_nationkey")


# Orders --------------------------------------------------------------------------


@query("""WITH i AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
 f AS (SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber) AS n FROM i WHERE l_returnflag <> 'N') WHERE n = 1)
 SELECT i.l_partkey, min(-f.l_orderkey) AS statement, CAST(min(f.l_linenumber) AS INTEGER) AS place, min(p_size) AS fallback FROM i LEFT JOIN f ON i.l_partkey = f.l_partkey GROUP BY 1""")
def source_order(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    items = table(spark, d, "lineitem").join(parts, "l_partkey").withColumn("source_order", F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")))
    out = views.source_order(items, "l_partkey", [(-F.col("l_orderkey")).alias("order")], F.col("p_size"))
    return out.select("l_partkey", F.col("statement_rank.order").alias("statement"), "place", "fallback")


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#21' THEN 1 WHEN 'Brand#13' THEN 2 WHEN 'Brand#32' THEN 3 ELSE 4 END AS place FROM part""")
def custom_order(spark, d):
    return table(spark, d, "part").select("p_partkey", views.listed_order(F.col("p_brand"), ["Brand#21", "Brand#13", "Brand#32"]).cast("int").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority = '5-LOW', o_orderdate, o_orderkey LIMIT 50")
def queue_pick(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    tasks = table(spark, d, "orders").select("o_orderkey", state.alias("state"), (F.col("o_orderpriority") == "5-LOW").alias("background"), F.col("o_orderdate").alias("created_at"))
    return views.queue_pick(tasks, F.col("o_orderkey"), n=50).select("o_orderkey")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_audit_rows(spark, d):
    return table(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100).select("event_id", "event_type")


# Roll-ups ------------------------------------------------------------------------


@query("""SELECT l_orderkey, count(*) AS tables_found, count(*) FILTER (l_linestatus = 'F') AS tables_parsed, CAST(sum(l_quantity) AS BIGINT) AS numeric_cells,
 CASE WHEN bool_or(l_linestatus <> 'F' OR l_returnflag = 'R') THEN 'partial' ELSE 'complete' END AS status FROM lineitem GROUP BY 1""")
def coverage_rollup(spark, d):
    quantity = F.col("l_quantity").cast("long")
    found = table(spark, d, "lineitem").select(
        "l_orderkey", F.lit(1).alias("tables_found"), (F.col("l_linestatus") == "F").cast("int").alias("tables_parsed"), quantity.alias("numeric_cells"), quantity.alias("extracted_cells"),
        F.lit(0).alias("blank_cells"), F.lit(0).alias("unreadable_cells"), F.when(F.col("l_linestatus") == "F", "complete").otherwise("partial").alias("status"),
        (F.col("l_returnflag") == "R").cast("int").alias("conflicts"), F.lit(0).alias("unmapped"),
    )
    return views.coverage_rollup(found, ["l_orderkey"]).select("l_orderkey", "tables_found", "tables_parsed", "numeric_cells", "status")


@query("""WITH m AS (SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'succeeded' END AS s, o_orderpriority = '5-LOW' AS gap, o_totalprice < 20000 AS warned, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
 SELECT o_custkey, count(*) FILTER (s = 'succeeded') AS done, count(*) FILTER (s = 'failed') AS failed,
 CASE WHEN count(*) FILTER (s = 'succeeded') = 0 THEN 'failed' WHEN count(*) FILTER (s = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS state,
 CASE WHEN count(*) FILTER (s = 'succeeded') = 0 THEN 'failed' WHEN count(*) FILTER (s = 'failed') > 0 OR bool_or(gap) THEN 'passed_with_gaps' WHEN bool_or(warned) THEN 'warning' ELSE 'passed' END AS quality,
 sha256(coalesce(string_agg(k || ':' || h, '' ORDER BY k || ':' || h) FILTER (s = 'succeeded'), '')) AS digest FROM m GROUP BY 1""")
def import_rollup(spark, d):
    key = F.col("o_orderkey").cast("string")
    modules = table(spark, d, "orders").select(
        "o_custkey", key.alias("module_key"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("state"), (F.col("o_orderpriority") == "5-LOW").alias("has_gaps"),
        (F.col("o_totalprice") < 20000).alias("warned"), F.md5(key).alias("sha256"),
    )
    return views.import_rollup(modules, ["o_custkey"])


@query("SELECT event_type, count(*) FILTER (user_id % 9 <> 0 AND value > 20) AS covered, count(*) FILTER (user_id % 9 <> 0) AS offered FROM events GROUP BY 1")
def coverage_by_category(spark, d):
    modules = table(spark, d, "events").select("event_type", (F.col("user_id") % 9 == 0).alias("unavailable"), F.when(F.col("value") > 20, "succeeded").otherwise("failed").alias("state"))
    return views.coverage_by_category(modules, ["event_type"])


@query("""SELECT o_custkey, concat_ws('|', CASE WHEN bool_or(o_orderstatus = 'P') THEN '来源待核对' END, CASE WHEN bool_or(o_totalprice < 30000) THEN '资产负债表勾稽不一致' END,
 CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '缺少披露项，未检查' END) AS labels FROM orders GROUP BY 1""")
def diagnostic_summary(spark, d):
    checks = F.array_compact(F.array(F.lit("passed"), F.when(F.col("o_totalprice") < 30000, "conflict"), F.when(F.col("o_orderpriority") == "1-URGENT", "not_checked_missing_disclosure")))
    statements = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", "needs_review").otherwise("consistent").alias("source_status"), checks.alias("check_statuses"))
    return views.diagnostic_summary(statements, ["o_custkey"], F.lit("资产负债表")).select("o_custkey", F.array_join("labels", "|").alias("labels"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 30000 THEN 'warning' WHEN o_orderstatus = 'F' THEN 'passed' ELSE 'not_checked' END AS status FROM orders""")
def formula_status(spark, d):
    rest = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("passed"), F.lit("passed"))).when(F.col("o_orderstatus") == "O", F.array().cast("array<string>")).otherwise(F.array(F.lit("passed"), F.lit("not_checked_unverified_source")))
    statuses = F.when(F.col("o_totalprice") < 30000, F.array(F.lit("conflict"), F.lit("passed"))).otherwise(rest)
    return table(spark, d, "orders").select("o_orderkey", views.formula_status(statuses).alias("status"))


@query("""WITH m AS (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS with_data, count(*) FILTER (o_orderstatus = 'P') AS without_data, CAST(sum(month(o_orderdate)) AS BIGINT) AS periods FROM orders GROUP BY 1),
 c AS (SELECT o_custkey, count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag = 'R') AS conflict, count(*) FILTER (l_returnflag = 'A') AS not_checked, count(DISTINCT l_returnflag) AS statuses FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
 SELECT m.*, passed, conflict, not_checked, statuses FROM m LEFT JOIN c ON m.o_custkey = c.o_custkey""")
def acceptance_summary(spark, d):
    orders = table(spark, d, "orders")
    modules = orders.select("o_custkey", (F.col("o_orderstatus") != "P").alias("has_data"), F.month("o_orderdate").alias("periods"))
    status = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "R", "conflict").otherwise("not_checked_missing_disclosure")
    checks = table(spark, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", status.alias("status"))
    return views.acceptance_summary(modules, checks, "o_custkey")


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, coalesce(c_acctbal < 0, false) AS review FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def diagnostic_lookup(spark, d):
    found = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") < 0).alias("review"))
    out = views.with_diagnostics(table(spark, d, "orders").select("o_orderkey", "o_custkey"), found, "o_custkey", {"segment": F.lit("none"), "review": F.lit(False)})
    return out.select("o_orderkey", "segment", "review")


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return tables.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'gap' WHEN toxic = 1 THEN 'warning' ELSE 'passed' END AS quality, CAST(quality AS DOUBLE) AS coverage FROM (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def view_projection(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    state = F.when(F.col("quality").isNull(), "gap").when(F.col("toxic") == 1, "warning").otherwise("passed")
    return both.select("doc_id", state.alias("quality"), F.col("quality").cast(DOUBLE).alias("coverage"))


# Records and rows ----------------------------------------------------------------


@query("SELECT p.p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, s_name) AS value FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey")
def hydration(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("values"))
    return views.hydrated(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("values")), ["p_partkey"]).select("p_partkey", F.col("values").alias("value"))


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS part, CASE i WHEN 0 THEN p_brand WHEN 1 THEN p_brand || '|balance' ELSE p_brand || '|allowance' END AS key,
 CASE i WHEN 0 THEN p_type WHEN 1 THEN '期末余额' ELSE '坏账准备' END AS label, CASE WHEN i < 2 THEN p_size END AS value FROM part, (SELECT unnest([0, 1, 2]) AS i)""")
def row_multiplication(spark, d):
    return views.aged_rows(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_brand", "p_type", "p_size")


@query("""WITH r AS (SELECT user_id, event_type || '_' || (event_id % 5) AS k, value, event_id, CAST(event_id % 5 AS VARCHAR) AS tail FROM events)
 SELECT event_id, k FROM r WHERE EXISTS (SELECT 1 FROM r x WHERE x.user_id = r.user_id AND x.tail = r.tail AND x.value > 60)""")
def active_rows(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.concat_ws("_", "event_type", (F.col("event_id") % 5).cast("string")).alias("k"), "value")
    return views.active_rows(rows, ["user_id"], F.col("k"), ~F.coalesce(F.col("value") > 60, F.lit(False))).select("event_id", "k")


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS name, p_size % 3 <> 0 AS nested, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS children
 FROM part GROUP BY 1, 2, CASE WHEN p_size % 3 = 0 THEN p_partkey END""")
def module_grouping(spark, d):
    modules = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("module_key"), F.col("p_name").alias("module_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("menu_parent"))
    return views.module_groups(modules, [], "p_partkey").select("name", "nested", F.array_join("children", ",").alias("children"))


@query("""SELECT doc_id, len(w) = n_chars % 4 AS even, CASE WHEN len(w) = n_chars % 4 THEN array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || i), ',') END AS pairs
 FROM (SELECT doc_id, n_chars, string_split(source, '-') AS w FROM documents)""")
def tag_alignment(spark, d):
    words = F.split("source", "-")
    numbers = F.slice(F.array(*[F.lit(i) for i in (1, 2, 3)]), F.lit(1), (F.col("n_chars") % 4).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", words.alias("w"), numbers.alias("n"))
    pairs = views.aligned(F.col("w"), F.col("n"))
    return docs.select("doc_id", pairs.isNotNull().alias("even"), F.array_join(F.transform(pairs, lambda x: F.concat(x["left"], x["right"].cast("string"))), ",").alias("pairs"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 7 = 0) THEN '%' WHEN p_size % 2 = 0 THEN '万元' ELSE '天' END AS unit FROM part""")
def cell_units(spark, d):
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "合并期末同比(%)").when(size % 7 == 0, "占收入比").otherwise("合并期末")
    return table(spark, d, "part").select("p_partkey", views.cell_unit(F.when(size % 2 == 0, "万元").otherwise("天"), kind, list(N.UNIT_SCALES)).alias("unit"))


@query("""WITH a AS (SELECT c_nationkey, max(abs(c_acctbal)) * 1e4 AS l, min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer GROUP BY 1),
 m AS (SELECT *, CASE WHEN l >= 1e12 THEN 12 WHEN l >= 1e9 THEN 9 WHEN l >= 1e6 THEN 6 WHEN l >= 1e3 THEN 3 ELSE 0 END AS magnitude FROM a),
 b AS (SELECT c_nationkey, magnitude, CAST(floor(a * pow(10.0, 4 - magnitude)) AS BIGINT) AS least, CAST(ceil(b * pow(10.0, 4 - magnitude)) AS BIGINT) AS most FROM m)
 SELECT c_nationkey, magnitude, least, CASE WHEN most = least THEN least + 1 ELSE most END AS most, (CASE WHEN most = least THEN least + 1 ELSE most END - least) / 5.0 AS interval FROM b""")
def axis_bounds(spark, d):
    return views.axis_bounds(table(spark, d, "customer"), ["c_nationkey"], "c_acctbal", F.lit(True), F.lit(4), False)


# JSON and maps -------------------------------------------------------------------


@query("""SELECT event_id, sha256('{"a":"' || event_type || '","k":' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || ',"z":[1,null]}') AS digest FROM events WHERE json_exists(props, '$.k')""")
def canonical_digest(spark, d):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "z" : [1, null], "k": '), k, F.lit(', "a":"'), F.col("event_type"), F.lit('" }'))
    return table(spark, d, "events").where(k.isNotNull()).select("event_id", J.json_digest(text).alias("digest"))


@example("""SELECT n, found FROM (VALUES (1, 'x'), (2, 'deep'), (3, NULL), (4, NULL), (5, 'first'), (6, NULL)) v(n, found)""")
def recursive_key_search(spark, d):
    rows = [(1, '{"md":"x"}'), (2, '{"a":[{"b":1},{"c":{"text":"deep"}}]}'), (3, '{"a":{"md":5}}'), (4, "not json"), (5, '[{"text":"first"},{"md":"second"}]'), (6, None)]
    return spark.createDataFrame(rows, "n int, raw string").select("n", J.found_under(F.col("raw"), ["md", "text"]).alias("found"))


@query("""SELECT event_id, event_type AS a, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'right' END AS b, 'new' AS c FROM events""")
def map_merge(spark, d):
    left = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("left"))
    right = F.create_map(F.lit("b"), F.when(F.col("user_id") % 2 != 0, F.lit("right")))
    both = J.updated(J.merged(left, right), F.lit("c"), F.lit("new"))
    return table(spark, d, "events").select("event_id", both["a"].alias("a"), both["b"].alias("b"), both["c"].alias("c"))


@query("""SELECT doc_id, strlen('{"id":' || doc_id || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null') || '}') AS bytes FROM documents""")
def json_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", J.json_bytes(F.struct(F.col("doc_id").alias("id"), "source")).cast("long").alias("bytes"))


@example("""SELECT n, ok FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, false)) v(n, ok)""")
def nonfinite_reject(spark, d):
    rows = [(1, '{"a":1.5}'), (2, '{"a":NaN}'), (3, "[Infinity]"), (4, '{"a":"NaN"}'), (5, '{"a":-Infinity}'), (6, "{")]
    return spark.createDataFrame(rows, "n int, raw string").select("n", J.canonical_json(F.col("raw")).isNotNull().alias("ok"))


# Scalars -------------------------------------------------------------------------


@example("""SELECT label, name FROM (VALUES ('非流动性资产处置损益', '非流动资产处置损益'), ('计入当期损益的政府补助', '政府补助'), ('减：所得税影响额', '所得税影响数'), ('其他符合非经常性损益定义的损益项目', '其他'), ('合计', '合计')) v(label, name)""")
def nonrecurring_labels(spark, d):
    labels = ["非流动性资产处置损益", "计入当期损益的政府补助", "减：所得税影响额", "其他符合非经常性损益定义的损益项目", "合计"]
    return spark.createDataFrame([(x,) for x in labels], "label string").select("label", T.nonrecurring_label(F.col("label")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE replace(p_brand, ' ', '') || '|' || replace(p_type, ' ', '') END AS header FROM part""")
def header_join(spark, d):
    return table(spark, d, "part").select("p_partkey", T.header_join(F.array("p_brand", F.concat(F.lit(" "), "p_brand"), "p_type", F.lit(None).cast("string"))).alias("header"))


@example("""SELECT raw, step FROM (VALUES ('1,234.50', '0.01'), ('(7)', '1'), ('1e3', '1000'), ('1.5e3', '100'), ('2.50e-1', '0.001'), ('x', NULL)) v(raw, step)""")
def increment_of(spark, d):
    raw = spark.createDataFrame([(x,) for x in ["1,234.50", "(7)", "1e3", "1.5e3", "2.50e-1", "x"]], "raw string")
    return raw.select("raw", N.exponent_increment(F.col("raw")).alias("step"))


@query("""SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(38,2)) / 10000000, 6) AS DOUBLE) AS wan FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal FROM customer) WHERE true""")
def quantize_six(spark, d):
    exact = F.col("c_acctbal").cast("decimal(18,2)") / F.lit(10000000).cast("decimal(8,0)")
    return table(spark, d, "customer").select("c_custkey", N.quantized(exact).cast(DOUBLE).alias("wan"))


@example("""SELECT n, shown FROM (VALUES (1, '80.00%'), (2, '33.33%'), (3, '0.12%'), (4, '0.14%'), (5, '—（分母为零）')) v(n, shown)""")
def percent_display(spark, d):
    rows = spark.createDataFrame([(1, "0.8", None), (2, "0.333333", None), (3, "0.00125", None), (4, "0.00135", None), (5, None, "分母为零")], "n int, v string, reason string")
    return rows.select("n", N.percent_display(F.col("v").cast("decimal(38,18)"), F.col("reason")).alias("shown"))


@example("""SELECT a, b, same FROM (VALUES ('1.0', '1.00', true), ('1e2', '100', true), ('1', '2', false), ('x', 'x', false), (NULL, NULL, false)) v(a, b, same)""")
def same_number(spark, d):
    rows = spark.createDataFrame([("1.0", "1.00"), ("1e2", "100"), ("1", "2"), ("x", "x"), (None, None)], "a string, b string")
    return rows.select("a", "b", N.same_number(F.col("a"), F.col("b")).alias("same"))


_CLAIMS = [("2025年12月31日", None, "balance_sheet"), ("2025-01-01/2025-06-30", "half_year", "income_statement"), ("2025-01-01/2025-06-30", "year", "income_statement"), ("2025-06-30/2025-01-01", None, "income_statement"),
           ("2025-01-01/2025-12-31", None, "balance_sheet"), ("2025年度", "year", "income_statement"), ("2025-12-31", None, "income_statement"), ("soon", None, "income_statement"), ("2025-02-30", None, "balance_sheet"), ("2024年12月31日（调整后）", None, "balance_sheet")]


@example("""SELECT raw, type, claim, period, kind, fault FROM (VALUES
 ('2025年12月31日', 'balance_sheet', NULL, '2025-12-31', 'instant', NULL), ('2025-01-01/2025-06-30', 'income_statement', 'half_year', '2025-01-01/2025-06-30', 'half_year', NULL),
 ('2025-01-01/2025-06-30', 'income_statement', 'year', NULL, NULL, 'period_kind_mismatch'), ('2025-06-30/2025-01-01', 'income_statement', NULL, NULL, NULL, 'period_order'),
 ('2025-01-01/2025-12-31', 'balance_sheet', NULL, NULL, NULL, 'balance_requires_instant'), ('2025年度', 'income_statement', 'year', '2025-01-01/2025-12-31', 'year', NULL),
 ('2025-12-31', 'income_statement', NULL, NULL, NULL, 'flow_requires_duration'), ('soon', 'income_statement', NULL, NULL, NULL, 'period_unknown'),
 ('2025-02-30', 'balance_sheet', NULL, NULL, NULL, 'period_invalid'), ('2024年12月31日（调整后）', 'balance_sheet', NULL, '2024-12-31', 'instant', NULL)) v(raw, type, claim, period, kind, fault)""")
def period_strict(spark, d):
    rows = spark.createDataFrame(_CLAIMS, "raw string, claim string, type string")
    return rows.withColumn("p", P.strict_period(F.col("raw"), F.col("claim"), F.col("type"))).select("raw", "type", "claim", "p.period", "p.kind", "p.fault")


@query("""SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS day, year(o_orderdate) || '-01-01/' || CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS period,
 CASE month(o_orderdate) WHEN 12 THEN 'year' WHEN 6 THEN 'half_year' ELSE 'year_to_date' END AS kind FROM orders""")
def supplement_periods(spark, d):
    days = table(spark, d, "orders").select(F.last_day("o_orderdate").alias("end")).distinct()
    return days.withColumn("p", P.supplement_period(F.col("end"))).select(F.col("end").cast("string").alias("day"), "p.period", "p.kind")
