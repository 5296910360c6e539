"""Facts that summary tables add to the statements: recurring profit, returns and shares, depreciation by kind.

Tables are told by the signature of their header, and by where they stand: summaries
before the consolidated balance sheet, depreciation under the consolidated notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import loose_number
from ..functions.periods import bound, report_end
from ..functions.text import compact
from .documents import CELL, LOOSE_HEADING, ROW, cell_text, newlines, only_preparer, row_markup, running, stated_columns, tables_of, without_code
from .notes import NOTE_HEADING

# Labels of rows and headers with what they stand for.
SUMMARY = {"归属于上市公司股东的扣除非经常性损益的净利润(元)": ("net_profit_excluding_nonrecurring", "元"), "加权平均净资产收益率": ("reported_roe", "%")}
RETURNS = [("reported_ex_roe", "扣非后加权净资产收益率", "%"), ("reported_ex_basic_eps", "扣非后基本每股收益", "元/股"), ("reported_ex_diluted_eps", "扣非后稀释每股收益", "元/股")]
RETURNS_HEAD, RETURNS_ROW = ["报告期利润", "加权平均净资产收益率"], "扣除非经常性损益后归属于公司普通股股东的净利润"
DEPRECIATION = {"固定资产折旧、油气资产折耗、生产性生物资产折旧": "fixed_depreciation", "使用权资产折旧": "rou_depreciation", "无形资产摊销": "intangible_amortization", "长期待摊费用摊销": "deferred_amortization"}
DEPRECIATION_HEAD, NOTES = ["补充资料", "本期金额", "上期金额"], "合并财务报表项目注释"
CURRENT, EARLIER, BEFORE, AFTER, SHARES = "本报告期", "上年同期", "本次变动前", "本次变动后", "股份总数"
PRIMARY = r"^#{1,6}\s*(?:[0-9一二三四五六七八九十]+[、．.]\s*)?合并资产负债表"

_FACT = "array<struct<concept:string,label:string,raw_value:string,raw_unit:string,period_start:date,period_end:date,statement_type:string>>"


def _fact(concept: Column | str, label: Column | str, raw: Column, unit: Column | str, start: Column, end: Column, kind: str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(concept).alias("concept"), text(label).alias("label"), raw.alias("raw_value"), text(unit).alias("raw_unit"), start.cast("date").alias("period_start"), end.cast("date").alias("period_end"), F.lit(kind).alias("statement_type"))


def _of_column(concept: str, unit: str):
    """The fact that a row's cell in a column (col, start, end) is."""
    return lambda p: _fact(concept, F.get("cells", F.lit(0)), F.get("cells", p["col"]), unit, p["start"], p["end"], "income_statement")


def _only(when: Column, *facts: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(*facts).cast(_FACT)).otherwise(F.array().cast(_FACT))


def _telling(first: Column) -> Column:
    """Whether a row whose first cell is this may hold a fact."""
    return (first == RETURNS_ROW) | compact(first).isin(list(SUMMARY)) | first.contains(SHARES) | first.isin(list(DEPRECIATION))


def summary_rows(docs: DataFrame) -> DataFrame:
    """Rows of tables that may hold a supplementary fact: document_id, end, years, primary, majors, header, at, row, line and cells.

    end: the report's; years: those of the consolidated statements' facts; primary: line of
    the consolidated balance sheet's heading, or 0; majors: line and title of numbered
    headings; header and at: cells and line of the table's first row. A document is read in
    its own row; it is exploded where a value is used more than once, and to its tables.
    """
    text = F.col("d.text")
    once = lambda **values: F.explode(F.array(F.struct(*[c.alias(n) for n, c in values.items()])))
    whole = F.col("text")
    given = docs.where("document_id IS NOT NULL").select("document_id", once(text=whole, end=report_end(whole), preparer=only_preparer(whole), shown=without_code(whole)).alias("d")).where("d.end IS NOT NULL")
    cut = given.select("document_id", "d", once(heads=F.regexp_extract_all("d.shown", F.lit(LOOSE_HEADING), F.lit(0)), parts=F.split("d.shown", LOOSE_HEADING)).alias("s"))
    columns = stated_columns(F.col("s.heads"), F.col("s.parts"), F.col("d.preparer"), F.col("d.end"))
    stated = cut.select("document_id", "d", once(columns=columns).alias("s")).select("document_id", "d", F.array_distinct("s.columns.entity").alias("entities"), F.array_compact(F.array_distinct("s.columns.year")).alias("years")).where(F.size("entities") == 1)
    own = stated.select("document_id", "d", "years", once(lines=F.split(text, "\r?\n"), pieces=F.split(text, ROW)).alias("x"))
    primary = F.get(F.array_compact(F.transform("x.lines", lambda x, i: F.when(x.startswith("#") & x.rlike(PRIMARY), i + 1))), F.lit(0))
    titled = F.transform("x.lines", lambda x, i: F.struct((i + 1).alias("line"), F.when(x.contains("#"), F.regexp_extract(x, NOTE_HEADING, 1)).alias("title")))
    majors = F.filter(titled, lambda h: F.coalesce(h["title"].rlike("^[一二三四五六七八九十]+、"), F.lit(False)))
    placed = own.select("document_id", F.col("d.end").alias("end"), "years", F.coalesce(primary, F.lit(0)).alias("primary"), majors.alias("majors"), F.col("x.pieces").alias("pieces"))
    numbered = placed.withColumn("lines", running.asNondeterministic()(F.transform("pieces", newlines)))
    kept = ["document_id", "end", "years", "primary", "majors"]
    zipped = numbered.select(*kept, F.explode(F.array(F.arrays_zip(F.col("pieces").alias("p"), F.col("lines").alias("line")))).alias("pieces"))
    tables = zipped.select(*kept, F.explode(tables_of(F.col("pieces"), lambda p: p["p"])).alias("rows"))
    first = lambda p: cell_text(F.regexp_extract(F.regexp_extract(p, r"(?is)^<tr\b.*?</tr\s*>", 0), CELL, 0))
    telling = F.filter(F.transform("rows", lambda r, i: F.struct((i + 1).alias("row"), r["line"].alias("line"), r["p"].alias("p"))), lambda r: bound(first(r["p"]), _telling))
    told = tables.select(*kept, F.get("rows", F.lit(0)).alias("first"), F.explode(F.array(telling)).alias("told")).where(F.size("told") > 0)
    cells = lambda p: F.transform(row_markup(p), cell_text)
    headed = told.select(*kept, "told", once(header=cells(F.col("first.p")), at=F.col("first.line") + 1).alias("h"))
    return headed.select(*kept, "h.header", "h.at", F.inline(F.transform("told", lambda r: F.struct(r["row"].alias("row"), (r["line"] + 1).alias("line"), cells(r["p"]).alias("cells")))))


def supplements(docs: DataFrame) -> DataFrame:
    """Supplementary facts of documents (document_id, text): concept, label, raw_value, raw_unit, value, period_start, period_end, statement_type and line.

    Only documents with a report period, and consolidated statements of one entity,
    have any. A cell that is no number is passed over. Percent signs stay in raw_value.
    A change of shares gives the numbers of shares, never the capital: the column before
    the closing percentage, and the first one where a percentage stands behind it.
    """
    rows = summary_rows(docs)
    cell = lambda i: F.get("cells", F.lit(i))
    n, header, end = F.size("cells"), F.col("header"), F.col("end")
    start = F.make_date(F.year("end"), F.lit(1), F.lit(1))
    a_year_before = lambda c: F.add_months(c, -12)
    summary = F.col("at") < F.col("primary")
    body = F.col("row") > 1

    returns = _only((F.slice("header", 1, 2) == F.array(*map(F.lit, RETURNS_HEAD))) & (n == 4) & (cell(0) == RETURNS_ROW), *[_fact(c, label, cell(i + 1), unit, start, end, "income_statement") for i, (c, label, unit) in enumerate(RETURNS)])
    compared = F.array_contains("header", CURRENT) & F.array_contains("header", EARLIER)
    label = compact(cell(0))
    named_year = lambda h: F.regexp_extract(F.regexp_replace(h, r"\s+", ""), "^(20[0-9]{2})年?$", 1)
    place = lambda name: F.array_position("header", name).cast("int") - 1
    day = lambda y, month, of_month: F.make_date(y.cast("int"), F.lit(month), F.lit(of_month))
    yearly = F.filter(F.transform("header", lambda h, i: bound(F.nullif(named_year(h), F.lit("")), lambda y: F.struct(i.alias("col"), day(y, 1, 1).alias("start"), day(y, 12, 31).alias("end"), F.coalesce(F.array_contains("years", y), F.lit(False)).alias("known")))), lambda p: p["known"])
    pair = F.array(*[F.struct(place(name).alias("col"), s.alias("start"), e.alias("end"), F.lit(True).alias("known")) for name, s, e in [(CURRENT, start, end), (EARLIER, a_year_before(start), a_year_before(end))]])
    none = F.slice(yearly, 1, 0)
    columns = F.when(F.coalesce(compared, F.lit(False)), pair).when(F.date_format("end", "MMdd") == "1231", yearly).otherwise(none)
    named = [(summary & body & (label == name)).alias(c) for name, (c, _) in SUMMARY.items()]
    told = F.array().cast(_FACT)
    for test, (_, (concept, unit)) in zip(named, SUMMARY.items(), strict=True):
        told = F.concat(told, F.when(F.coalesce(test, F.lit(False)), F.transform(columns, _of_column(concept, unit)).cast(_FACT)).otherwise(F.array().cast(_FACT)))
    joined = F.array_join("header", "")
    share = summary & joined.contains(BEFORE) & joined.contains(AFTER) & cell(0).contains(SHARES) & (n >= 5) & F.element_at("cells", -1).endswith("%") & ~F.element_at("cells", -2).endswith("%")
    nothing = F.lit(None).cast("date")
    shares = F.concat(
        _only(share, _fact("ordinary_share_count", "期末股份总数", F.element_at("cells", -2), "股", nothing, end, "balance_sheet")),
        _only(share & cell(2).endswith("%"), _fact("ordinary_share_count", "期初股份总数", cell(1), "股", nothing, F.make_date(F.year("end") - 1, F.lit(12), F.lit(31)), "balance_sheet")),
    )
    above = F.try_element_at(F.filter("majors", lambda m: m["line"] < F.col("at")), F.lit(-1))["title"]
    kinds = F.create_map(*[F.lit(x) for pair in DEPRECIATION.items() for x in pair])
    spent = (F.slice("header", 1, 3) == F.array(*map(F.lit, DEPRECIATION_HEAD))) & above.contains(NOTES) & body & cell(0).isin(list(DEPRECIATION))
    depreciation = _only(spent, *[_fact(F.try_element_at(kinds, cell(0)), cell(0), cell(i + 1), "元", s, e, "cash_flow_statement") for i, (s, e) in enumerate([(start, end), (a_year_before(start), a_year_before(end))])])

    found = rows.select("document_id", "line", F.inline(F.concat(returns, told, shares, depreciation)))
    value = loose_number(F.regexp_replace("raw_value", "[%％]+$", ""), bound).cast("decimal(28,8)")
    return found.select("*", F.explode(F.array(value)).alias("value")).where("value IS NOT NULL")  # exploded so that it is worked out once
