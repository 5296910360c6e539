"""Scalars, texts and joins over values that are derived from the tables: labels, numbers, periods, links, evidence as reports write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import numbers as N
from ..functions import periods as P
from ..functions import text as T
from ..operators import documents as D
from ..operators import matrix, metrics, notes
from ..operators import modules as M
from ..sources import readers
from ..sources.readers import table
from .registry import query

DOUBLE = "double"


def pick(number, *choices):
    """The choice that the number, modulo how many there are, says."""
    out = None
    for i, choice in enumerate(choices):
        out = (F if out is None else out).when(F.pmod(number, F.lit(len(choices))) == i, choice)
    return out


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


money = lambda name: F.format_number(F.col(name).cast("decimal(18,2)"), 2)


# Labels --------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '1年内' WHEN 1 THEN (p_size % 8 + 1) || '-' || (p_size % 8 + 2) || '年' ELSE (p_size % 8 + 1) || '年以上' END AS age FROM part""")
def age_labels(spark, d):
    n = F.pmod("p_size", F.lit(8)) + 1
    raw = pick(F.col("p_partkey"), text("1年以内（含", n, "年）"), text(n, " 年至", n + 1, "年"), text(n, "年 以上"))
    return table(spark, d, "part").select("p_partkey", T.age_label(raw).alias("age"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 99 THEN p_size END AS n FROM part")
def section_numbers(spark, d):
    digit = lambda n: F.substring(F.lit("一二三四五六七八九"), n.cast("int"), F.lit(1))
    tens, ones = F.floor(F.col("p_size") / 10), F.pmod("p_size", F.lit(10))
    raw = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.section_number(raw).alias("n"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 1 THEN url ELSE '第' || page_id || '页' END AS label, CASE WHEN page_id % 3 = 0 AND regexp_matches(url, '^https?://\\S+$') THEN url END AS url FROM pages""")
def source_links(spark, d):
    raw = pick(F.col("page_id"), text("第", F.col("page_id"), "页__", F.col("url")), F.col("url"), text("第", F.col("page_id"), "页__ftp", F.substring("url", 5, 1000)))
    return table(spark, d, "pages").select("page_id", T.link_label(raw).alias("label"), T.link_url(raw).alias("url"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '非流动资产处置损益' WHEN 1 THEN '政府补助' WHEN 2 THEN '所得税影响数' ELSE p_name END AS name FROM part""")
def nonrecurring_labels(spark, d):
    raw = pick(F.col("p_partkey"), text("非流动性", F.col("p_name"), "处置"), text("计入", F.col("p_name"), "的政府补助"), text("减：所得税影响额", F.col("p_name")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.nonrecurring_label(raw).alias("name"))


@query("""WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '营业收入' ELSE replace(p_name, ' ', '') END AS clean FROM part)
 SELECT p_partkey, clean, CASE clean WHEN '营业收入' THEN 'revenue' ELSE 'disclosed_' || substr(sha256('income_statement:' || clean), 1, 32) END AS concept FROM c""")
def label_normalise(spark, d):
    raw = pick(F.col("p_partkey"), text("十二、", F.col("p_name"), "（净亏损以“－”号填列）"), text(" （", F.pmod("p_size", F.lit(9)) + 1, "） 其中： ", F.col("p_name")), F.lit("一、 营业收入"))
    raw = F.when(F.pmod("p_partkey", F.lit(3)) == 1, text("（", F.pmod("p_size", F.lit(9)) + 1, "） 其中： ", F.col("p_name"))).otherwise(raw)
    return table(spark, d, "part").select("p_partkey", T.clean_label(raw).alias("clean"), T.concept_for(raw, F.lit("income_statement")).alias("concept"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text' WHEN 2 THEN 'office' ELSE 'unsupported_format' END AS tool FROM documents""")
def converter_routes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.converter_for(text(F.col("source"), "/", F.col("doc_id"), pick(F.col("doc_id"), F.lit(".tar.PDF"), F.lit(".Md"), F.lit(".v2.xlsx"), F.lit(""), F.lit(".pdf.gz")))).alias("tool"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def column_filter(spark, d):
    scope = F.when(F.col("o_orderstatus") == "F", "合并期末").otherwise("母公司期末")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "").when(F.col("o_orderpriority") == "2-HIGH", "同比(%)").otherwise("环比(%)")
    return matrix.column_filter(table(spark, d, "orders").select("o_orderkey", F.concat(scope, kind).alias("name")), "name", "合并期末", "原始报表,同比增长率").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderstatus = 'F' THEN '合并期末' ELSE '母公司期初' END AS scope,
 CASE WHEN o_orderkey % 7 = 0 THEN '同比' WHEN o_orderpriority = '1-URGENT' THEN '原始报表' WHEN o_orderpriority = '2-HIGH' THEN '同比增长率' ELSE '环比增长率' END AS kind FROM orders""")
def scope_kind_filter(spark, d):
    scope = F.when(F.col("o_orderstatus") == "F", "合并期末").otherwise("母公司期初")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "").when(F.col("o_orderpriority") == "2-HIGH", "同比(%)").otherwise("环比(%)")
    found = matrix.scope_and_kind(F.when(F.col("o_orderkey") % 7 == 0, "同比").otherwise(F.concat(scope, kind)))
    return table(spark, d, "orders").select("o_orderkey", found[0].alias("scope"), found[1].alias("kind"))


# Numbers -------------------------------------------------------------------------

_KEYS = "l_orderkey, l_linenumber"


@query(f"""SELECT {_KEYS}, CAST(CASE l_linenumber % 4 WHEN 3 THEN NULL WHEN 2 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) * 10000 AS DOUBLE) AS value FROM lineitem""")
def number_parse_note(spark, d):
    shown = money("l_extendedprice")
    raw = pick(F.col("l_linenumber"), shown, text(shown, "%"), text("（", shown, "）"), text(shown, ","))
    raw = F.when(F.pmod("l_linenumber", F.lit(4)) == 2, text("(", F.replace(shown, F.lit(","), F.lit("")), ")")).otherwise(raw)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.note_number(raw, 10000).cast(DOUBLE).alias("value"))


@query(f"""SELECT {_KEYS}, CASE l_linenumber % 4 WHEN 0 THEN '0.01' WHEN 1 THEN '1' WHEN 2 THEN '10' END AS step FROM lineitem""")
def increment_of(spark, d):
    raw = pick(F.col("l_linenumber"), money("l_extendedprice"), text("(", F.floor("l_quantity"), ")"), text(F.floor("l_quantity"), ".25e3"), text("x", F.floor("l_quantity")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.exponent_increment(raw).alias("step"))


@query("""WITH a AS (SELECT c_custkey, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS v, c_acctbal < 0 AS low FROM customer)
 SELECT c_custkey, CASE WHEN low AND v <> 0 THEN '-' ELSE '' END || rtrim(rtrim(CAST(v AS VARCHAR), '0'), '.') AS text FROM a""")
def canonical_decimals(spark, d):
    raw = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit("00"), F.abs(F.col("c_acctbal").cast("decimal(18,2)")).cast("string"), F.lit("0"))
    return table(spark, d, "customer").select("c_custkey", N.canonical_decimal(raw).alias("text"))


@query("""WITH q AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer), r AS (SELECT c_custkey, CAST(floor(cents / 100.0) AS BIGINT) AS q, cents - CAST(floor(cents / 100.0) AS BIGINT) * 100 AS rest FROM q),
 s AS (SELECT c_custkey, CASE WHEN rest > 50 OR (rest = 50 AND q % 2 <> 0) THEN q + 1 ELSE q END AS q FROM r)
 SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '—（分母为零）' ELSE CASE WHEN q < 0 THEN '-' ELSE '' END || (abs(q) // 100) || '.' || lpad(CAST(abs(q) % 100 AS VARCHAR), 2, '0') || '%' END AS shown FROM s""")
def percent_display(spark, d):
    value = F.when(F.col("c_custkey") % 5 != 0, (F.col("c_acctbal").cast("decimal(18,2)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(38,18)"))
    return table(spark, d, "customer").select("c_custkey", N.percent_display(value, F.lit("分母为零")).alias("shown"))


@query("SELECT c_custkey, c_custkey % 4 < 2 AS same FROM customer")
def same_number(spark, d):
    own = F.col("c_acctbal").cast("decimal(18,2)")
    other = pick(F.col("c_custkey"), text(" ", own, "00"), text(own * 100, "e-2"), text(own + F.lit(1).cast("decimal(18,2)")), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", N.same_number(own.cast("string"), other).alias("same"))


_RATIO_TERMS = {"liabilities_to_assets": ["2-HIGH", "1-URGENT"], "interest_bearing_debt_to_assets": ["3-MEDIUM", "1-URGENT"], "quick_ratio": ["4-NOT SPECIFIED", "none", "5-LOW"]}
_RATIO_NAMES = {"1-URGENT": "total_assets", "2-HIGH": "total_liabilities", "3-MEDIUM": "interest_bearing_debt", "4-NOT SPECIFIED": "current_assets", "5-LOW": "current_liabilities", "none": "inventory"}


def _ratio_sql() -> str:
    parts = []
    for code, terms in _RATIO_TERMS.items():
        case = " ".join(f"WHEN n['{t}'] IS NULL THEN 'missing_required_input:{_RATIO_NAMES[t]}' WHEN n['{t}'] > 1 THEN 'unresolved_fact_conflict'" for t in terms)
        parts.append(f"SELECT project, '{code}' AS code, v['{terms[0]}'] AS top, v['{terms[-1]}'] AS low, CASE {case} WHEN v['{terms[-1]}'] = 0 THEN 'zero_denominator' END AS reason FROM m")
    return f"""WITH f AS (SELECT o_custkey AS project, o_orderpriority AS p, count(*) AS n, max(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS v FROM orders GROUP BY 1, 2),
 m AS (SELECT project, map_from_entries(list((p, n))) AS n, map_from_entries(list((p, CAST(v AS DOUBLE)))) AS v FROM f GROUP BY 1), r AS ({' UNION ALL '.join(parts)})
 SELECT project, code, CASE WHEN reason IS NULL THEN round(top / low, 8) END AS value, reason FROM r"""


@query(_ratio_sql())
def fact_ratios(spark, d):
    concept = T.lookup(F.col("o_orderpriority"), _RATIO_NAMES)
    value = F.when(F.col("o_orderstatus") == "P", "0").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    same = [F.lit(x).alias(c) for c, x in [("entity", "e"), ("scope", "s"), ("period", "2026"), ("currency", "CNY"), ("unit", "元")]]
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), concept.alias("concept"), value.alias("value"), *same)
    return metrics.fact_ratios(facts).select("project", "code", F.round(F.col("value").cast(DOUBLE), 8).alias("value"), "reason")


# Periods -------------------------------------------------------------------------

#: A balance of a year's first day is the one of the day before.
_BALANCE = "CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN CAST(o_orderdate AS DATE) - 1 ELSE CAST(o_orderdate AS DATE) END"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST({_BALANCE} AS VARCHAR) WHEN 1 THEN year(o_orderdate) || '-01-01/' || year(o_orderdate) || '-12-31' WHEN 4 THEN CAST({_BALANCE} AS VARCHAR) END AS period,
 CASE o_orderkey % 5 WHEN 2 THEN 'flow_requires_duration' WHEN 3 THEN CASE WHEN month(o_orderdate) = 1 AND day(o_orderdate) = 1 THEN NULL ELSE 'period_order' END END AS fault FROM orders WHERE o_orderkey % 5 <> 3 OR NOT (month(o_orderdate) = 1 AND day(o_orderdate) = 1)""")
def period_strict(spark, d):
    day, year = F.to_date("o_orderdate"), F.year("o_orderdate")
    written = text(year, "年", F.month("o_orderdate"), "月", F.dayofmonth("o_orderdate"), "日")
    key = F.col("o_orderkey")
    raw = pick(key, written, text(year, "-01-01/", year, "-12-31"), written, text(day, "/", year, "-01-01"), text(year, "年 ", F.month("o_orderdate"), "月", F.dayofmonth("o_orderdate"), "日（调整后）"))
    kind = pick(key, F.lit("balance_sheet"), F.lit("income_statement"), F.lit("income_statement"), F.lit("income_statement"), F.lit("balance_sheet"))
    first = (F.month("o_orderdate") == 1) & (F.dayofmonth("o_orderdate") == 1)
    rows = table(spark, d, "orders").where((F.pmod("o_orderkey", F.lit(5)) != 3) | ~first).select("o_orderkey", P.strict_period(raw, F.lit(None).cast("string"), kind).alias("p"))  # a span of one day isn't out of order
    return rows.select("o_orderkey", "p.period", "p.fault")


@query(f"""WITH y AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) + 20 AS y FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN y || '-06-30' WHEN 1 THEN (y - 1) || '-12-31' WHEN 2 THEN y || '-03-07' END AS stock, CASE k WHEN 3 THEN y || 'H1' WHEN 4 THEN y || '年度' END AS flow FROM y""")
def column_periods(spark, d):
    year = F.year("o_orderdate") + 20
    head = pick(F.col("o_orderkey"), F.lit("期末余额"), F.lit("年初余额"), text(year, " 年3月7日"), text(year, "年半年度"), text(year, "年"), F.lit("附注"))
    end = F.make_date(year, F.lit(6), F.lit(30))
    return table(spark, d, "orders").select("o_orderkey", D.column_period(head, F.lit("balance_sheet"), end).alias("stock"), D.column_period(head, F.lit("income_statement"), end).alias("flow"))


@query("""WITH y AS (SELECT o_orderkey, o_orderkey % 5 AS k, year(o_orderdate) + 20 AS y FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN y || '-12-31' WHEN 1 THEN y || '-06-30' WHEN 2 THEN y || '-03-31' WHEN 3 THEN y || '-09-30' END AS period FROM y""")
def report_ends(spark, d):
    year = F.year("o_orderdate") + 20
    raw = text("# ", F.col("o_orderpriority"), pick(F.col("o_orderkey"), text(year, " 年年度报告"), text(year, "年半年度报告摘要"), text(year, "年第一季度报告"), text(year, "年第三季度报告"), text(year, "年报告")))
    return table(spark, d, "orders").select("o_orderkey", P.report_end(raw).cast("string").alias("period"))


@query("""WITH y AS (SELECT o_orderkey, o_orderkey % 5 AS k, year(o_orderdate) + 20 AS y FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN y || '-12-31' WHEN 1 THEN (y - 1) || '-12-31' WHEN 2 THEN (y - 1) || '-12-31' WHEN 3 THEN (y - 2) || '-12-31' END AS period FROM y""")
def note_periods(spark, d):
    year = F.year("o_orderdate") + 20
    head = pick(F.col("o_orderkey"), F.lit("期末 余额"), F.lit("期初余额"), F.lit("上期发生额"), text(year - 2, "年金额"), F.lit("比例"))
    return table(spark, d, "orders").select("o_orderkey", D.note_period(head, F.make_date(year, F.lit(12), F.lit(31))).cast("string").alias("period"))


# Texts and JSON ------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10))[doc_id % 3 + 1] AS line FROM documents)
 SELECT doc_id, coalesce(line IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 5 <> 0, false) AS proven FROM l""")
def fact_import(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text")
    line = F.pmod("doc_id", F.lit(3)) + 1
    quote = F.when(F.col("doc_id") % 2 == 0, F.get(F.split("text", "\n"), line.cast("int") - 1)).otherwise("no such line")
    facts = docs.select("document_id", "doc_id", line.cast("int").alias("line"), quote.alias("quote"), F.when(F.col("doc_id") % 5 != 0, F.sha2("text", 256)).otherwise("0").alias("sha256"))
    return readers.proven_facts(facts, docs.select("document_id", "text")).select("doc_id", "proven")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'deep' || user_id END AS found FROM events""")
def recursive_key_search(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    raw = pick(F.col("event_id"), text('{"a":[1,{"md":5}],"text":"', kind, '"}'), text('{"text":"","p":', F.col("props"), ',"a":[{"b":1},{"c":{"text":"deep', user, '"}}]}'), text('{"a":{"md":', user, "}}"), text('{"md":"', kind))
    return table(spark, d, "events").select("event_id", J.found_under(raw, ["md", "text"]).alias("found"))


@query("SELECT event_id, event_id % 4 IN (0, 2) AS ok FROM events")
def nonfinite_reject(spark, d):
    raw = pick(F.col("event_id"), text('{"v":', F.col("value"), "}"), text('{"v":[', F.col("value"), ",NaN]}"), text('{"v":"NaN","t":"', F.col("event_type"), '"}'), text('{"v":-Infinity,"u":', F.col("user_id"), "}"))
    return table(spark, d, "events").select("event_id", J.canonical_json(raw).isNotNull().alias("ok"))


@query("""SELECT l_orderkey, count(*) AS n, string_agg('L' || l_linenumber || '=' || format('{:,.2f}', l_extendedprice), ';' ORDER BY l_linenumber, format('{:,.2f}', l_extendedprice)) AS cells FROM lineitem GROUP BY 1""")
def wrapped_rows(spark, d):
    """Amounts whose last decimal stands on a row of its own are read as one."""
    shown = money("l_extendedprice")
    cut = F.length(shown) - 1
    pair = F.array(F.array(text("L", F.col("l_linenumber")), F.substring(shown, F.lit(1), cut), F.lit("")), F.array(F.lit(""), F.substring(shown, cut + 1, F.lit(1)), F.lit("")))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", pair.alias("rows")).alias("r"))
    tables = rows.groupBy("l_orderkey").agg(F.flatten(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["rows"])).alias("rows"))
    cells = F.transform("rows", lambda r: F.concat(r[0], F.lit("="), r[1]))
    return notes.rejoined(tables).select("l_orderkey", F.size("rows").cast("long").alias("n"), F.array_join(cells, ";").alias("cells"))


@query("""SELECT l_orderkey, 1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, format('{:,.2f}', l_extendedprice)) AS row_no, '1 | ' || l_linenumber || '~`x | ' || l_returnflag || '`~' || format('{:,.2f}', l_extendedprice) AS cells FROM lineitem
 UNION ALL SELECT DISTINCT l_orderkey, 1, 'a~b~c' FROM lineitem""")
def markdown_tables(spark, d):
    """Pipe tables written from order lines are read back, escaped and quoted pipes included."""
    line = F.concat(F.lit("| 1 \\| "), F.col("l_linenumber").cast("string"), F.lit(" | `x | "), "l_returnflag", F.lit("` | "), money("l_extendedprice"), F.lit(" |"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda r: r["t"]), "\n")
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.concat(F.lit("para\n| a | b | c |\n|:--|---|--:|\n"), body, F.lit("\n\nend | not")).alias("text"))
    return D.pipe_rows(docs).select(F.col("document_id").alias("l_orderkey"), F.col("row").cast("long").alias("row_no"), F.array_join("cells", "~").alias("cells"))


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS period, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CASE WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 END) = 1 THEN count(*) END AS growth FROM orders GROUP BY 1, 2""")
def indicator_trend(spark, d):
    years = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("period_raw")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("a"), F.when(F.bool_or(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("g"))
    cells = F.array(F.struct(F.lit("1").alias("row_key"), F.col("a").cast("string").alias("value")), F.struct(F.lit("1_2").alias("row_key"), F.col("g").cast("string").alias("value")), F.struct(F.lit("2").alias("row_key"), F.lit("0").alias("value")))
    rows = years.select(F.col("o_custkey").alias("module_key"), "period_raw", F.inline(cells))
    return M.trend(rows, "1").select(F.col("module_key").alias("o_custkey"), F.col("period_raw").alias("period"), F.col("amount").cast(DOUBLE).alias("amount"), F.col("growth").cast("long").alias("growth"))
