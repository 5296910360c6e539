"""Checking what was read from a table against the table itself.

Inputs are tables: physical ``cells`` (document_id, block_id, row, col, is_header,
text), their dense ``grid`` (at_row, at_col, row, col, text), declared ``columns`` of
amounts, declared ``others`` (columns without amounts), and the ``claims`` of a reader
about each row. Nothing here corrects a value; it says what doesn't agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import UNIT_SCALES, source_increment, strict_number, unit_scale
from ..functions.periods import bound, strict_period
from ..functions.text import ALIASES, BLANK_SOURCE, compact_quote

BLOCK = ["document_id", "block_id"]
#: Words that prove a scope and a currency, units in order of length, and the concepts a statement can't do without. Fixed values.
SCOPE_WORDS = {"consolidated": ["合并", "consolidated"], "parent": ["母公司", "parent"], "standalone": ["单体", "个别", "standalone"]}
CURRENCY_WORDS = {"CNY": ["人民币", "CNY", "RMB"], "USD": ["美元", "USD"], "HKD": ["港元", "港币", "HKD"], "EUR": ["欧元", "EUR"]}
UNIT_TOKENS = "百万元|千元|万元|亿元|元/股|元"
CORE = {
    "balance_sheet": ["total_assets", "total_equity", "total_liabilities"], "income_statement": ["cost", "net_profit", "revenue", "total_profit"],
    "cash_flow_statement": ["net_financing_cash_flow", "net_increase_in_cash", "net_investing_cash_flow", "net_operating_cash_flow"],
}
#: Concepts that a claim may name.
CONCEPTS = sorted(set(ALIASES.values()) | {"cash_and_cash_equivalents"})


def proven(quotes: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Quotes (document_id, block_id, key, start_line, end_line, quote) with ``proven``: whether the cited lines hold the quote inside an allowed span.

    ``spans``: document_id, block_id, start_offset, end_offset (half open, in characters), what may prove
    something about a block; spans that touch are one. A quote may occur several times in its lines.
    """
    by = W.partitionBy(*BLOCK).orderBy("start_offset", "end_offset")
    reach = F.max("end_offset").over(by.rowsBetween(W.unboundedPreceding, -1))
    joined = spans.withColumn("_new", (reach.isNull() | (F.col("start_offset") > reach)).cast("int")).withColumn("_g", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    merged = joined.groupBy(*BLOCK, "_g").agg(F.min("start_offset").alias("l"), F.max("end_offset").alias("r"))
    allowed = merged.groupBy(*BLOCK).agg(F.collect_list(F.struct("l", "r")).alias("allowed"))  # the spans around one block
    lines = F.split("text", "\n")
    given = quotes.join(docs.select("document_id", lines.alias("lines")), "document_id").join(allowed, BLOCK, "left")
    low = F.coalesce(F.aggregate(F.slice("lines", F.lit(1), F.col("start_line") - 1), F.lit(0), lambda n, x: n + F.length(x) + 1), F.lit(0))
    window = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    cut = F.split(F.col("_w"), F.concat(F.lit("\\Q"), "quote", F.lit("\\E")), -1)
    given = given.withColumn("_low", low).withColumn("_w", window)
    starts = F.transform(F.sequence(F.lit(1), F.size("_cut") - 1), lambda i: F.col("_low") + F.length(F.array_join(F.slice("_cut", F.lit(1), i), "")) + F.length("quote") * (i - 1))
    hit = F.exists(starts, lambda a: F.exists("allowed", lambda s: (s["l"] <= a) & (a + F.length("quote") <= s["r"])))
    sound = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.size("lines"))
    found = given.withColumn("_cut", F.when(sound, cut)).withColumn("proven", F.coalesce(F.when(F.size("_cut") > 1, hit), F.lit(False)))
    return found.select(*quotes.columns, "proven")


def header_of(grid: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` (block, column, header_rows) with the text of their header over those rows, joined by spaces; null for a column that isn't there."""
    # headers stand at the top: cells below the deepest header row that is declared aren't shuffled
    deepest = columns.agg(F.max(F.array_max("header_rows")).alias("_deepest"))
    upper = grid.join(F.broadcast(deepest), F.col("at_row") <= F.col("_deepest"))
    rows = columns.select(*BLOCK, "column", F.explode("header_rows").alias("at_row")).join(upper.select(*BLOCK, "at_row", F.col("at_col").alias("column"), "text"), [*BLOCK, "at_row", "column"])
    heads = rows.groupBy(*BLOCK, "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_row", "text"))), lambda x: x["text"]), " ").alias("header"))
    size = grid.groupBy(*BLOCK).agg(F.max("at_row").alias("_rows"), F.max("at_col").alias("_cols"))
    return columns.join(heads, [*BLOCK, "column"], "left").join(size, BLOCK, "left")


def _says(text: Column, words: dict[str, list[str]], of: Column) -> Column:
    """Whether a proof holds one of the words of what it is to prove."""
    found = F.lit(False)
    for name, own in words.items():
        hit = F.lit(False)
        for word in own:
            hit = hit | F.contains(text, F.lit(word))
        found = found | ((of == name) & hit)
    return F.coalesce(found, F.lit(False))


def metadata_issues(columns: DataFrame, grid: DataFrame) -> DataFrame:
    """What doesn't hold of the declared columns of amounts: ``columns`` with header, period_found, kind_found and issues.

    ``columns`` has the block, column, label_column, header_rows, raw_header, period,
    period_kind, period_basis, statement_type, entity, scope, currency, raw_unit,
    structure_issues and proofs (a map from entity, scope, unit, currency,
    statement_type and period to the text proven; a key without a proof is missing).
    The unit's proof is the whole line that was quoted from: its one unit must be the claimed one.
    """
    found = header_of(grid, columns)
    proof = lambda key: F.coalesce(F.try_element_at("proofs", F.lit(key)), F.lit(""))
    units = F.array_distinct(F.regexp_extract_all(proof("unit"), F.lit(f"({UNIT_TOKENS})"), F.lit(1)))
    claimed = strict_period(F.col("period"), F.col("period_kind"), F.col("statement_type"))
    found = found.withColumn("_p", claimed).withColumn("_h", strict_period(F.col("header"), F.lit(None).cast("string"), F.col("statement_type")))
    years = F.regexp_extract_all("header", F.lit("((?:19|20)[0-9]{2})"), F.lit(1))
    dates = F.transform(F.regexp_extract_all("header", F.lit("((?:19|20)[0-9]{2}[-年/][01]?[0-9][-月/][0-3]?[0-9])"), F.lit(1)), lambda x: F.try_to_date(F.regexp_replace(x, "[年月/]", "-"), "yyyy-M-d"))
    period = F.col("_p.period")
    year = F.substring(F.element_at(F.split(F.coalesce(period, F.col("period")), "/"), -1), 1, 4)
    stated = F.regexp_extract_all(proof("period"), F.lit("((?:19|20)[0-9]{2})"), F.lit(1))
    opening = F.when((F.col("period_basis") == "opening") & year.rlike("^[0-9]{4}$"), (year.cast("int") + 1).cast("string"))
    read = F.col("_h.fault").isNull()
    dated = F.exists(dates, lambda x: x.cast("string") == period)
    absent = F.col("_cols").isNull() | (F.col("column") == F.col("label_column"))
    issue = lambda when, code: F.when(F.coalesce(when, F.lit(False)), F.lit(code))
    about = [
        issue(~F.contains(compact_quote(proof("entity")), compact_quote(F.col("entity"))), "entity_evidence_missing"), issue(~_says(F.lower(proof("scope")), SCOPE_WORDS, F.col("scope")), "scope_evidence_missing"),
        issue(~F.col("raw_unit").isin(list(UNIT_SCALES)) | (F.size(units) != 1) | (F.get(units, F.lit(0)) != F.col("raw_unit")), "unit_evidence_missing"),
        issue(~_says(proof("currency"), CURRENCY_WORDS, F.col("currency")), "currency_evidence_missing"), issue(proof("statement_type") == "", "statement_type_evidence_missing"),
        issue(proof("period") == "", "period_evidence_missing"), issue(F.col("_p.fault").isNotNull(), "period_invalid"), issue(absent, "column_invalid"),
    ]
    header = F.coalesce("header", F.lit(""))
    in_table = [
        issue(F.size("structure_issues") > 0, "source_structure_issue"), issue((F.col("column") > F.col("_cols")) | (F.col("label_column") > F.col("_cols")), "column_invalid"),
        issue(F.exists("header_rows", lambda r: (r < 1) | (r > F.col("_rows"))), "header_invalid"), issue(header == "", "header_missing"), issue(compact_quote(header) != compact_quote(F.col("raw_header")), "raw_header_mismatch"),
        issue(F.when(read, F.col("_h.period") != period), "column_period_mismatch"), issue(~read & F.exists(dates, lambda x: x.isNull()), "header_date_invalid"),
        issue(~read & (((F.size(dates) > 0) & ~dated) | ((F.size(years) > 0) & ~F.array_contains(years, year) & ~dated)), "column_period_mismatch"),
        issue(~read & (F.size(years) == 0) & ~(F.array_contains(stated, year) | F.coalesce(F.array_contains(stated, opening), F.lit(False))), "period_evidence_ambiguous"),
        issue((header.contains("母公司") & (F.col("scope") != "parent")) | (header.contains("合并") & (F.col("scope") != "consolidated")), "column_scope_mismatch"),
    ]
    issues = F.array_distinct(F.array_compact(F.when(absent, F.array(*about)).otherwise(F.array(*about, *in_table))))
    return found.select(*columns.columns, "header", period.alias("period_found"), F.col("_p.kind").alias("kind_found"), issues.alias("issues"))


def non_amount_issues(others: DataFrame, columns: DataFrame, grid: DataFrame) -> DataFrame:
    """What doesn't hold of the columns declared to have no amounts: ``others`` (block, column, header_rows, raw_header, proof) with issues; valid where there are none."""
    used = columns.select(*BLOCK, "column").unionByName(columns.select(*BLOCK, F.col("label_column").alias("column"))).distinct().withColumn("_used", F.lit(True))
    again = F.row_number().over(W.partitionBy(*BLOCK, "column").orderBy("raw_header")) > 1
    found = header_of(grid, others.withColumn("_again", again)).join(used, [*BLOCK, "column"], "left")
    absent, headless = F.col("_cols").isNull() | (F.col("column") > F.col("_cols")), F.exists("header_rows", lambda r: (r < 1) | (r > F.col("_rows")))
    issue = lambda when, code: F.when(F.coalesce(when, F.lit(False)), F.lit(code))
    there = ~absent & ~headless
    proof = compact_quote(F.coalesce("proof", F.lit("")))
    issues = F.array_compact(F.array(
        issue(F.col("_again"), "duplicate_non_amount_column"), issue(F.col("_used"), "non_amount_column_overlap"), issue(absent, "non_amount_column_invalid"), issue(~absent & headless, "non_amount_header_invalid"),
        issue(there & (compact_quote(F.coalesce("header", F.lit(""))) != compact_quote(F.col("raw_header"))), "non_amount_header_mismatch"),
        issue(there & ((proof == "") | ~F.contains(compact_quote(F.col("raw_header")), proof)), "non_amount_evidence_missing"),
    ))
    return found.select(*others.columns, issues.alias("issues")).withColumn("valid", F.size("issues") == 0)


def numeric_census(cells: DataFrame, grid: DataFrame, columns: DataFrame, others: DataFrame) -> DataFrame:
    """Every physical cell with a strictly readable number, whatever a reader made of it: block, row, col, text and hidden.

    Columns validly declared to have no amounts are left out. A bare year in a
    declared header row is a heading where it stands in the first row, in a header
    cell, or beside a label merged from above. hidden: another number in such a row.
    """
    numbers = cells.where(strict_number(F.col("text")).isNotNull()).join(others.where("valid").select(*BLOCK, F.col("column").alias("col")), [*BLOCK, "col"], "left_anti")
    heads = columns.select(*BLOCK, F.explode("header_rows").alias("row")).distinct().withColumn("_head", F.lit(True))
    labels = columns.select(*BLOCK, F.col("label_column").alias("at_col")).distinct()
    merged = grid.join(labels, [*BLOCK, "at_col"]).where("row < at_row").select(*BLOCK, F.col("at_row").alias("row")).distinct().withColumn("_merged", F.lit(True))
    found = numbers.join(heads, [*BLOCK, "row"], "left").join(merged, [*BLOCK, "row"], "left")
    head = F.coalesce("_head", F.lit(False))
    year = compact_quote(F.col("text")).rlike("^(?:19|20)[0-9]{2}$") & ((F.col("row") == 1) | F.col("is_header") | F.coalesce("_merged", F.lit(False)))
    return found.where(~(head & year)).select(*BLOCK, "row", "col", "text", head.alias("hidden"))


def checked_cells(cells: DataFrame, columns: DataFrame, claims: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """The state of every cell of declared columns that a reader claimed: VERIFIED, CONFLICT, GAP or UNMAPPED, and why.

    ``columns``: as returned by ``metadata_issues``. ``claims``: block, row,
    source_name, concept, role, raw_unit and values (array<struct<column,raw_value>>).
    ``second``: what another reader found (document_id, line, source_name, period,
    concept, value, scope, entity, currency); cells then need a line. It can only disagree, never supply a value.
    Returns the block, row, col, statement_type, period_found, concept, source_name,
    raw_value, raw_unit, value (given for VERIFIED and UNMAPPED), state, status and
    issues, and for a number that no data row claims the state MISSING.
    """
    header = columns.select(*BLOCK, "column", "label_column", "header_rows", "statement_type", "period_found", "kind_found", "entity", "scope", "currency", F.col("raw_unit").alias("unit"), F.col("issues").alias("own"))
    values = cells.select(*BLOCK, "row", F.col("col").alias("column"), F.col("text").alias("raw_value"), *(["line"] if "line" in cells.columns else []))
    names = cells.select(*BLOCK, "row", F.col("col").alias("label_column"), F.trim("text").alias("source_name"))
    rows = values.join(header, [*BLOCK, "column"]).where(~F.array_contains("header_rows", F.col("row"))).join(names, [*BLOCK, "row", "label_column"]).where("source_name <> ''")
    per_row = claims.groupBy(*BLOCK, "row").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct(F.col("source_name").alias("name"), "concept", "role", F.col("raw_unit").alias("u"), "values"), "source_name").alias("c"))
    found = rows.join(per_row, [*BLOCK, "row"], "left")
    data = F.col("c").isNotNull() & ~F.coalesce(F.col("c.role").isin("header", "section"), F.lit(False))
    given = lambda own: F.struct(F.size(own).alias("times"), F.when(F.size(own) == 1, strict_number(F.get(own, F.lit(0))["raw_value"])).alias("claimed"))
    supplied = bound(F.filter("c.values", lambda v: v["column"] == F.col("column")), given)
    renamed = lambda name: (compact_quote(F.col("c.name")) != name) & (F.col("c.name") != F.col("source_name"))  # noqa: E731  the same text is the same label
    named = bound(compact_quote(F.col("source_name")), lambda name: F.struct(name.alias("label"), renamed(name).alias("renamed")))
    blank = F.trim("raw_value").isin(BLANK_SOURCE)
    unit = F.coalesce("c.u", "unit")
    odd_unit = F.col("c.u").isNotNull() & (F.col("c.u") != F.col("unit")) & ~((F.col("c.u") == "元/股") & F.col("source_name").contains("每股"))
    scale = F.when(unit == "元/股", F.lit(1).cast("decimal(10,0)")).otherwise(unit_scale(unit))
    mapped = F.coalesce(F.col("c.concept").isin(CONCEPTS), F.lit(False))
    made = F.concat(F.lit("disclosed_"), F.substring(F.sha2(F.concat("statement_type", F.lit(":"), F.col("_r.name.label")), 256), 1, 32))
    issue = lambda when, code: F.when(F.coalesce(when, F.lit(False)), F.lit(code))
    # exploded so that texts are read once for each cell, before the filter by state
    read = F.struct(strict_number(F.col("raw_value")).alias("v"), supplied.alias("given"), strict_number(F.col("source_name")).isNotNull().alias("numeric"), named.alias("name"))
    found = found.select("*", F.explode(F.array(read)).alias("_r"))
    checked = found.withColumn("_v", F.col("_r.v")).withColumn("_data", data).withColumn("amount", (F.col("_v") * scale).cast("decimal(28,8)")).withColumn("concept", F.when(mapped, F.col("c.concept")).otherwise(made))
    disagrees = F.lit(False)
    if second is not None:
        mine = second.select(F.col("document_id").alias("_doc"), F.col("line").alias("_line"), compact_quote(F.col("source_name")).alias("_own"), F.col("period").alias("_period"), F.struct("concept", F.col("value").alias("v"), "scope", "entity", "currency").alias("o"))
        mine = mine.groupBy("_doc", "_line", "_own", "_period").agg(F.collect_list("o").alias("opinions"))  # one line's readings
        same_cell = (F.col("document_id") == F.col("_doc")) & (F.col("line") == F.col("_line")) & (F.col("_r.name.label") == F.col("_own")) & (F.col("period_found") == F.col("_period"))
        checked = checked.join(mine, same_cell, "left").drop("_doc", "_line", "_own", "_period")
        same = lambda o: (o["scope"] == F.col("scope")) & (o["entity"] == F.col("entity")) & (o["currency"] == F.col("currency")) & o["v"].eqNullSafe(F.col("amount")) & ((o["concept"] == F.col("concept")) | o["concept"].startswith("disclosed_"))
        disagrees = F.exists("opinions", lambda o: ~F.coalesce(same(o), F.lit(False)))
    sourced = F.array_distinct(F.concat("own", F.array_compact(F.array(
        issue(F.col("_r.numeric"), "source_name_is_numeric"), issue(F.col("_n") > 1, "duplicate_model_row"), issue(F.col("_r.name.renamed"), "source_name_mismatch"),
        issue(F.col("_r.given.times") != 1, "model_cell_missing_or_duplicate"), issue(~F.col("_v").eqNullSafe(F.col("_r.given.claimed")), "source_value_mismatch"),
        issue(F.col("_v").isNull() & blank, "source_blank"), issue(F.col("_v").isNull() & ~blank, "source_number_unreadable"), issue(odd_unit, "row_unit_not_supported"),
    ))))
    checked = checked.select("*", F.explode(F.array(sourced)).alias("_s"))
    state = (
        F.when(~F.col("_data"), F.when(F.col("_v").isNotNull(), "MISSING")).when(F.arrays_overlap("_s", F.array(*map(F.lit, ["source_value_mismatch", "source_name_mismatch", "duplicate_model_row"]))), "CONFLICT")
        .when(F.size("_s") > 0, "GAP").when(~mapped, "UNMAPPED").otherwise("VERIFIED")
    )
    checked = checked.withColumn("state", state).where("state IS NOT NULL")
    same_fact = W.partitionBy("document_id", "statement_type", "entity", "scope", "currency", "kind_found", "period_found", "concept")
    shown = F.when(F.col("state").isin("VERIFIED", "UNMAPPED"), F.col("amount"))
    checked = checked.withColumn("_shown", shown).withColumn("_clash", (F.size(F.collect_set("_shown").over(same_fact)) > 1) & F.col("_shown").isNotNull() & ~F.col("concept").startswith("disclosed_"))
    final = F.when(F.col("_clash"), "CONFLICT").otherwise(F.col("state"))
    status = F.when(final == "VERIFIED", "source_verified").when(final.isin("CONFLICT", "UNMAPPED"), "pending_confirmation").when(final == "GAP", "source_value_not_found")
    return checked.select(
        *BLOCK, "row", F.col("column").alias("col"), "statement_type", "period_found", "concept", "source_name", "raw_value", unit.alias("raw_unit"), F.when(~F.col("_clash"), F.col("_shown")).alias("value"), final.alias("state"),
        status.alias("status"), source_increment(F.col("raw_value")).alias("source_increment"),
        F.concat(F.when(final == "MISSING", F.array().cast("array<string>")).otherwise(F.col("_s")), F.array_compact(F.array(issue(disagrees, "local_disagreement"), issue(F.col("_clash"), "duplicate_concept_conflict")))).alias("issues"),
    )


def table_coverage(cells: DataFrame, census: DataFrame, checked: DataFrame) -> DataFrame:
    """Of each document: physical numbers, those claimed and not, blank and unreadable cells, missing core concepts, and complete or partial."""
    # of each statement, whether it occurs and which core concepts are verified, as bits
    bits = {pair: 1 << i for i, pair in enumerate((t, c) for t, cs in CORE.items() for c in (None, *sorted(cs)))}
    core = F.lit(0)
    for (t, c), bit in bits.items():
        told = F.col("statement_type") == t if c is None else (F.col("statement_type") == t) & (F.col("status") == "source_verified") & (F.col("concept") == c)
        core = core + F.when(told, bit).otherwise(0)
    number = F.when(F.col("state").isin("CONFLICT", "GAP"), strict_number(F.col("raw_value")).isNotNull()).otherwise(False)
    says = lambda code: F.array_contains("issues", code).cast("long")
    of_checked = checked.select(*BLOCK, "row", "col", (F.col("state") != "MISSING").alias("claimed"), says("source_blank").alias("blank"), says("source_number_unreadable").alias("unreadable"), number.alias("bad"), core.alias("core"))
    of_census = census.select(*BLOCK, "row", "col", F.lit(1).alias("numbers"), "hidden")
    # a cell's numbers and claims meet in one pass, so that neither side is worked out twice
    per_cell = of_checked.unionByName(of_census, allowMissingColumns=True).groupBy(*BLOCK, "row", "col").agg(
        F.count("numbers").alias("numbers"), F.bool_or("claimed").alias("claimed"), F.bool_or("hidden").alias("hidden"), F.sum("blank").alias("blank"), F.sum("unreadable").alias("unreadable"), F.bool_or("bad").alias("bad"), F.bit_or("core").alias("core")
    )
    own = per_cell.groupBy("document_id").agg(
        F.sum("numbers").alias("numeric_cells"), F.sum(F.when(F.col("claimed"), F.col("numbers")).otherwise(0)).alias("extracted_cells"), F.bool_or("hidden").alias("_hidden"),
        F.sum("blank").alias("blank_cells"), F.sum("unreadable").alias("unreadable_cells"), F.bool_or("bad").alias("_bad"), F.bit_or("core").alias("_core"),
    )
    lacks = lambda t, c: F.when((F.col("_core").bitwiseAND(bits[t, None]) != 0) & (F.col("_core").bitwiseAND(bits[t, c]) == 0), F.lit(c))
    gaps = F.when(F.col("_core").isNotNull(), F.array_sort(F.array_compact(F.array(*[lacks(t, c) for t, c in bits if c is not None]))))
    out = own.where("numeric_cells > 0").withColumn("missing_core", gaps)
    missing = F.col("numeric_cells") - F.col("extracted_cells")
    partial = (missing > 0) | F.col("_bad") | F.col("_hidden") | (F.size("missing_core") > 0) | (F.col("unreadable_cells") > 0)
    return out.select("document_id", "numeric_cells", "extracted_cells", missing.alias("missing_numeric_cells"), "blank_cells", "unreadable_cells", "missing_core", F.when(partial, "partial").otherwise("complete").alias("status"))


def review_reasons(issues: Column) -> Column:
    """Of a table's issues those that a reader should look at again: not absent core concepts, not blanks. Sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(issues, lambda x: ~x.startswith("missing_core:") & (x != "source_blank"))))


def should_review(issues: Column, check_statuses: Column) -> Column:
    return (F.size(review_reasons(issues)) > 0) | F.array_contains(check_statuses, "conflict")


def statement_key(table_id: Column, parts: list[Column], header: Column) -> Column:
    """Stable key of a statement: a digest of its table, its identity, and whether its header is before or after adjustment."""
    qualifier = F.when(header.contains("调整前"), "调整前").when(header.contains("调整后"), "调整后").otherwise("")
    return F.substring(F.sha2(F.to_json(F.array(table_id, *[p.cast("string") for p in parts], qualifier)), 256), 1, 24)


def fragment_keys(kind: list[str], header: Column, issues: Column, origin: list[Column]) -> list[Column]:
    """The parts of the key under which fragments of a statement are one: its identity, the adjustment it names, and its own place where its metadata has issues."""
    text = compact_quote(header)
    qualifier = F.when(text.contains("调整前"), "调整前").when(text.contains("调整后"), "调整后").otherwise("")
    apart = F.when(F.size(issues) > 0, F.concat_ws("/", *origin)).otherwise("")
    return [*map(F.col, kind), qualifier.alias("qualifier"), apart.alias("origin")]


#: Questions of a draft and the metric that answers each; claims that nothing can prove. Fixed values.
QUESTIONS = {"Q001": "liabilities_to_assets", "Q002": "interest_bearing_debt_to_assets", "Q003": "quick_ratio"}
UNPROVABLE = "已完成现场|无诉讼|已审核|还款有保障"


def draft_faults(segments: DataFrame, answers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Faults of drafts: draft_id and fault, a row for each; a draft without faults has none.

    ``segments``: draft_id, block_id, kind (text or metric), text, ref. ``answers``:
    draft_id, question_id, status, block_ids. ``metrics``: draft_id, code, value.
    """
    blocks = segments.select("draft_id", "block_id").distinct()
    given = answers.select("draft_id", "question_id", "status", F.explode_outer("block_ids").alias("block_id"))
    fault = lambda rows, code: rows.select("draft_id", F.lit(code).alias("fault")).distinct()
    asked = answers.groupBy("draft_id").agg(F.array_sort(F.collect_set("question_id")).alias("q"))
    wanted = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    refs = segments.where("kind = 'metric'")
    bound = given.join(refs.select("draft_id", "block_id", "ref"), ["draft_id", "block_id"], "left").withColumn("code", F.try_element_at(wanted, F.col("question_id")))
    per = bound.groupBy("draft_id", "question_id", "status", "code").agg(F.bool_or(F.coalesce(F.col("ref") == F.col("code"), F.lit(False))).alias("has"))
    known = per.join(metrics.select("draft_id", "code", "value"), ["draft_id", "code"], "left")
    parts = [
        fault(asked.where(F.col("q") != F.array(*map(F.lit, sorted(QUESTIONS)))), "question_coverage"), fault(given.join(blocks, ["draft_id", "block_id"], "left_anti"), "unknown_block"),
        fault(blocks.join(given, ["draft_id", "block_id"], "left_anti"), "unbound_block"), fault(per.where("NOT has"), "question_metric_binding_missing"),
        fault(known.where("value IS NULL AND status = 'answered'"), "missing_metric_marked_answered"),
        fault(refs.withColumnRenamed("ref", "code").join(metrics, ["draft_id", "code"], "left_anti"), "unknown_metric_ref"),
        fault(segments.where((F.col("kind") == "text") & F.col("text").rlike(f"[0-9０-９]|{UNPROVABLE}")), "unbound_number_or_unverified_claim"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extracted_statement_issues(items: DataFrame, statement: list[str]) -> DataFrame:
    """Items of extracted statements (scope, period_kind, raw_unit, concept, unscaled, in_source) with value, status and issues.

    A concept with several distinct numbers in a statement is pending, and so is
    everything of an unknown scope, period or unit; a number that isn't in the source wasn't found.
    """
    same = W.partitionBy(*statement, "concept")
    clash = F.size(F.collect_set("unscaled").over(same)) > 1
    scale = F.when(F.col("raw_unit") == "元/股", F.lit(1).cast("decimal(10,0)")).otherwise(unit_scale(F.col("raw_unit")))
    issue = lambda when, code: F.when(F.coalesce(when, F.lit(True)), code)
    issues = F.array_compact(F.array(
        issue(F.col("scope").isNull() | (F.col("scope") == "unknown"), F.lit("scope_unknown")), issue(F.col("period_kind").isNull(), F.lit("period_unknown")), issue(scale.isNull(), F.lit("unit_unknown")),
        issue(clash, F.concat(F.lit("multiple_values_for_concept:"), "concept")),
    ))
    done = items.withColumn("issues", issues)
    status = F.when(~F.coalesce("in_source", F.lit(False)) | F.col("unscaled").isNull(), "source_value_not_found").when(F.size("issues") > 0, "pending_confirmation").otherwise("source_verified")
    return done.withColumn("status", status).withColumn("value", F.when(F.col("status") != "source_value_not_found", F.col("unscaled") * scale).cast("decimal(28,8)"))
