"""Labels, concepts and cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Account label -> concept, for the labels that have a standard name. Fixed values.
ALIASES = {
    "货币资金": "cash", "交易性金融资产": "trading_financial_assets", "应收票据": "notes_receivable", "应收账款": "accounts_receivable",
    "应收款项融资": "receivables_financing", "预付款项": "prepayments", "预付账款": "prepayments", "其他应收款": "other_receivables",
    "存货": "inventory", "合同资产": "contract_assets", "流动资产合计": "total_current_assets", "固定资产": "fixed_assets",
    "在建工程": "construction_in_progress", "使用权资产": "right_of_use_assets", "无形资产": "intangible_assets",
    "非流动资产合计": "total_noncurrent_assets", "资产总计": "total_assets", "短期借款": "short_term_borrowings", "应付票据": "notes_payable",
    "应付账款": "accounts_payable", "合同负债": "contract_liabilities", "其他应付款": "other_payables",
    "一年内到期的非流动负债": "current_portion_noncurrent_liabilities", "流动负债合计": "total_current_liabilities", "长期借款": "long_term_borrowings",
    "应付债券": "bonds_payable", "租赁负债": "lease_liabilities", "非流动负债合计": "total_noncurrent_liabilities", "负债合计": "total_liabilities",
    "所有者权益合计": "total_equity", "所有者权益(或股东权益)合计": "total_equity", "营业收入": "revenue", "营业成本": "cost",
    "税金及附加": "taxes_and_surcharges", "销售费用": "selling_expenses", "管理费用": "administrative_expenses",
    "研发费用": "research_and_development_expenses", "财务费用": "finance_expenses", "其他收益": "other_income", "投资收益": "investment_income",
    "信用减值损失": "credit_impairment_loss", "资产减值损失": "asset_impairment_loss", "营业利润": "operating_profit", "利润总额": "total_profit",
    "所得税费用": "income_tax_expense", "净利润": "net_profit", "归属于母公司股东的净利润": "net_profit_attributable_to_parent",
    "营业外收入": "nonoperating_income", "营业外支出": "nonoperating_expense", "销售商品、提供劳务收到的现金": "cash_received_from_sales",
    "经营活动现金流入小计": "operating_cash_inflows", "经营活动现金流出小计": "operating_cash_outflows",
    "经营活动产生的现金流量净额": "net_operating_cash_flow", "投资活动产生的现金流量净额": "net_investing_cash_flow",
    "筹资活动产生的现金流量净额": "net_financing_cash_flow", "汇率变动对现金及现金等价物的影响": "exchange_rate_effect",
    "现金及现金等价物净增加额": "net_increase_in_cash", "期初现金及现金等价物余额": "beginning_cash_balance", "期末现金及现金等价物余额": "ending_cash_balance",
}

#: Two sets of cells that count as blank: where statements are read, and where tables are exported.
BLANK_SOURCE = ["", "-", "—", "–", "－", "不适用"]
BLANK_EXPORT = ["", "-", "--", "—"]


def compact(text: Column) -> Column:
    """Without white space, with ASCII parentheses and colons."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "（）：", "():")


def compact_quote(text: Column) -> Column:
    """Without white space, with ASCII parentheses and commas."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "（），", "(),")


def clean_label(label: Column) -> Column:
    """An account name without numbering, lead-ins and explanatory parentheses."""
    bare = F.regexp_replace(compact(label), r"^(?:[一二三四五六七八九十]+、|[0-9]+[.．]|\([一二三四五六七八九十0-9]+\))", "")
    bare = F.regexp_replace(bare, r"^(?:其中|加|减):", "")
    return F.regexp_replace(bare, r"\((?:净亏损|亏损|损失|亏损总额).*$", "")


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A constant dictionary as a map; null where the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def concept_for(label: Column, statement_type: Column) -> Column:
    """The standard concept of a label, or a stable identifier made of its type and clean name."""
    name = clean_label(label)
    made = F.concat(F.lit("disclosed_"), F.substring(F.sha2(F.concat(statement_type, F.lit(":"), name), 256), 1, 32))
    return F.coalesce(lookup(name, ALIASES), made)


def provider_concept(name: Column) -> Column:
    """As ``concept_for``, for provider rows: the identifier is made of the source's name alone."""
    return F.coalesce(lookup(clean_label(name), ALIASES), F.concat(F.lit("disclosed_"), F.substring(F.sha2(name, 256), 1, 32)))


def age_label(text: Column) -> Column:
    bare = F.regexp_replace(compact(text), r"\(.*?\)", "")
    span = F.regexp_replace(bare, r"([0-9])年?[至~—－-]([0-9])年", "$1-$2年")
    return F.when(bare.isin("1年以内", "1年以下", "一年以内"), "1年内").otherwise(span)


#: Words in a label of a non-recurring item -> its name; the first that occurs counts. Fixed values.
NONRECURRING = {
    "非流动": "非流动资产处置损益", "政府补助": "政府补助", "资金占用费": "资金占用费", "公允价值变动": "投资收益", "减值准备转回": "已计提减值准备的转回", "债务重组": "债务重组损益",
    "其他营业外": "其他营业外收入和支出", "所得税影响": "所得税影响数", "少数股东权益影响": "少数股东损益影响数", "其他符合": "其他",
}


def nonrecurring_label(label: Column) -> Column:
    return F.coalesce(*[F.when(label.contains(word), name) for word, name in NONRECURRING.items()], label)


def header_join(parts: Column, separator: str = "|") -> Column:
    """A column's header over several rows: its distinct fragments without white space, in order. Null parts are passed over."""
    return F.array_join(F.array_distinct(F.transform(parts, compact)), separator)


def contains_folded(text: Column, query: str) -> Column:
    """Whether a text holds the query, whatever the case."""
    return F.coalesce(F.lower(text).contains(query.lower()), F.lit(False))


def section_number(text: Column) -> Column:
    """Chinese numerals from 1 to 99 as an integer; null otherwise."""
    digits = {c: str(i + 1) for i, c in enumerate("一二三四五六七八九")}
    digit = lambda c: F.coalesce(lookup(c, digits).cast("int"), F.lit(0))
    tens = F.regexp_extract(text, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 1)
    ones = F.regexp_extract(text, "^([一二三四五六七八九]?)十([一二三四五六七八九]?)$", 2)
    return F.when(text.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), F.greatest(digit(tens), F.lit(1)) * 10 + digit(ones)).when(
        text.rlike("^[一二三四五六七八九]$"), digit(text)
    )


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags and leading # dropped, the five predefined entities and no-break space decoded."""
    text = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"^\s*#+\s*", "")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def csv_guard(cell: Column) -> Column:
    """A cell that a spreadsheet can't take for a formula: prefixed unless it is a plain number."""
    return F.when(cell.rlike(r"^\s*[=+@-]") & ~cell.rlike(r"^-?[0-9][0-9,.]*$"), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|\r\n]', "_")


def link_label(value: Column) -> Column:
    """The label of ``label__url``."""
    return F.split_part(value, F.lit("__"), F.lit(1))


def link_url(value: Column) -> Column:
    """The http(s) address of ``label__url``, or null."""
    url = F.regexp_extract(value, r"__(https?://\S+)$", 1)
    return F.when(url != "", url)


def is_blank_source(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin(BLANK_SOURCE)


def is_blank_export(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin(BLANK_EXPORT)


def converter_for(name: Column) -> Column:
    """Which converter reads a file, by its suffix."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(suffix.isin("txt", "md", "markdown", "csv"), "text").when(suffix.isin("pdf", "png", "jpg", "jpeg"), "ocr")
        .when(suffix.isin("docx", "xlsx", "pptx"), "office").otherwise("unsupported_format")
    )
