"""The 119 metrics of a reporting period, as data.

A metric names its inputs in the order in which they are looked up, the guarded
ratios it needs, and its value. ``{0}`` stands for the first input, ``{r0}`` for
the first ratio, ``{days}`` for the period's 30/360 days. Every ratio is guarded: a
zero or negative denominator makes the metric unavailable.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from ..functions.text import ALIASES

BS, IS, CF = "balance_sheet", "income_statement", "cash_flow_statement"
VERSION = "statement-metrics-1"
#: Order in which categories are shown. Fixed values.
CATEGORIES = ["利润表", "资产负债表", "每股指标", "盈利能力", "偿债能力", "营运能力", "成长能力", "现金流量", "杜邦分析", "勾稽检查"]
INCOME, BALANCE, SHARE, PROFIT, DEBT, TURNOVER, GROWTH, CASH, DUPONT, CHECK = CATEGORIES


def disclosed(label: str, table: str) -> str:
    """The identifier of a clean label without a standard concept, as ``functions.text.concept_for`` makes it."""
    return "disclosed_" + hashlib.sha256(f"{table}:{label}".encode()).hexdigest()[:32]


#: Short names of inputs without a standard concept: (concept, table, label).
OWN = {
    "parent_equity": (disclosed("归属于母公司所有者权益合计", BS), BS, "归属于母公司所有者权益合计"),
    "total_revenue": (disclosed("营业总收入", IS), IS, "营业总收入"),
    "total_cost": (disclosed("营业总成本", IS), IS, "该科目"),
    "basic_eps": (disclosed("基本每股收益", IS), IS, "基本每股收益"),
    "diluted_eps_reported": (disclosed("稀释每股收益", IS), IS, "稀释每股收益"),
    "interest": (disclosed("利息费用", IS), IS, "该科目"),
    "capital_reserve": (disclosed("资本公积", BS), BS, "该科目"),
    "surplus_reserve": (disclosed("盈余公积", BS), BS, "该科目"),
    "retained_earnings": (disclosed("未分配利润", BS), BS, "该科目"),
    "long_term_payables": (disclosed("长期应付款", BS), BS, "该科目"),
    "net_profit_excluding_nonrecurring": ("net_profit_excluding_nonrecurring", IS, "扣非后归母净利润"),
}
#: Table of every other input.
TABLES = {
    IS: "revenue cost total_profit net_profit net_profit_attributable_to_parent asset_impairment_loss credit_impairment_loss operating_profit "
    "selling_expenses administrative_expenses research_and_development_expenses finance_expenses reported_roe reported_ex_roe reported_ex_basic_eps reported_ex_diluted_eps",
    BS: "total_assets total_liabilities total_equity total_current_assets total_current_liabilities inventory cash notes_receivable accounts_receivable accounts_payable "
    "fixed_assets short_term_borrowings current_portion_noncurrent_liabilities long_term_borrowings lease_liabilities ordinary_share_count",
    CF: "net_operating_cash_flow net_investing_cash_flow net_financing_cash_flow net_increase_in_cash ending_cash_balance cash_received_from_sales "
    "fixed_depreciation rou_depreciation intangible_amortization deferred_amortization",
}
TABLE_OF = {name: table for table, names in TABLES.items() for name in names.split()}
#: Unit that an input must have; yuan otherwise. Fixed values.
UNIT_OF = {
    "ordinary_share_count": "股", "reported_roe": "%", "reported_ex_roe": "%", "reported_ex_basic_eps": "元/股", "reported_ex_diluted_eps": "元/股",
    "basic_eps": "元/股", "diluted_eps_reported": "元/股",
}
LABEL_OF = {concept: label for label, concept in ALIASES.items()}
OFFSETS = {"": "current", "open": "opening", "prev": "previous", "quarter": "previous_quarter"}


@dataclass(frozen=True)
class Input:
    concept: str
    table: str
    offset: str
    unit: str
    label: str


@dataclass(frozen=True)
class Metric:
    code: str
    label: str
    category: str
    unit: str
    inputs: tuple[Input, ...]
    ratios: tuple[tuple[str, str], ...]
    value: str
    whole_months: bool = False


def term(name: str) -> Input:
    """``name`` or ``name@open``, ``name@prev``, ``name@quarter``."""
    short, _, offset = name.partition("@")
    concept, table, label = OWN.get(short) or (short, TABLE_OF[short], LABEL_OF.get(short, "该科目"))
    return Input(concept, table, OFFSETS[offset], UNIT_OF.get(short, "元"), label)


CATALOGUE: list[Metric] = []


def add(code: str, label: str, category: str, unit: str, inputs: str, value: str, *ratios: tuple[str, str], whole_months: bool = False) -> None:
    CATALOGUE.append(Metric(code, label, category, unit, tuple(map(term, inputs.split())), ratios, value, whole_months))


def share(code: str, label: str, category: str, inputs: str, top: str, bottom: str, unit: str = "%") -> None:
    """A ratio, in percent where that is the unit."""
    add(code, label, category, unit, inputs, "{r0} * 100" if unit == "%" else "{r0}", (top, bottom))


def growth(code: str, label: str, name: str, offset: str) -> None:
    add(code, label, GROWTH, "%", f"{name} {name}@{offset}", "{r0} * 100", ("{0} - {1}", "abs({1})"))


def added(first: int, last: int) -> str:
    return " + ".join(f"{{{i}}}" for i in range(first, last + 1))


AMORTISED = "fixed_depreciation rou_depreciation intangible_amortization deferred_amortization"
SHORT = "short_term_borrowings current_portion_noncurrent_liabilities"
LONG = "long_term_borrowings lease_liabilities long_term_payables"

for _code, _label, _category in [
    ("revenue", "营业收入", INCOME), ("total_profit", "利润总额", INCOME), ("net_profit", "净利润", INCOME),
    ("net_profit_attributable_to_parent", "归母净利润", INCOME), ("net_profit_excluding_nonrecurring", "扣非后归母净利润", INCOME),
    ("total_assets", "总资产", BALANCE), ("total_liabilities", "总负债", BALANCE), ("total_equity", "净资产", BALANCE),
    ("net_operating_cash_flow", "经营现金流量净额", CASH), ("net_investing_cash_flow", "投资现金流量净额", CASH), ("net_financing_cash_flow", "筹资现金流量净额", CASH),
    ("net_increase_in_cash", "现金及现金等价物净增加额", CASH), ("ending_cash_balance", "期末现金及现金等价物余额", CASH),
]:
    add(_code, _label, _category, "元", _code, "{0}")
add("asset_impairment_loss", "资产减值损失", INCOME, "元", "asset_impairment_loss", "-{0}")
add("credit_impairment_loss", "信用减值损失", INCOME, "元", "credit_impairment_loss", "-{0}")
add(OWN["total_revenue"][0], "营业总收入", INCOME, "元", "total_revenue", "{0}")
add(OWN["parent_equity"][0], "归属于母公司所有者权益合计", BALANCE, "元", "parent_equity", "{0}")
add(OWN["basic_eps"][0], "基本每股收益", SHARE, "元/股", "basic_eps", "{0}")
add(OWN["diluted_eps_reported"][0], "稀释每股收益", SHARE, "元/股", "diluted_eps_reported", "{0}")
share("gross_margin", "销售毛利率", PROFIT, "revenue cost", "{0} - {1}", "{0}")
share("net_margin", "销售净利率", PROFIT, "net_profit revenue", "{0}", "{1}")
share("operating_margin", "营业利润率", PROFIT, "operating_profit revenue", "{0}", "{1}")
share("roa", "总资产收益率（期间）", PROFIT, "net_profit total_assets@open total_assets", "{0}", "({1} + {2}) / 2")
share("roe_total", "净资产收益率（全体股东）", PROFIT, "net_profit total_equity@open total_equity", "{0}", "({1} + {2}) / 2")
share("debt_ratio", "资产负债率", DEBT, "total_liabilities total_assets", "{0}", "{1}")
share("current_ratio", "流动比率", DEBT, "total_current_assets total_current_liabilities", "{0}", "{1}")
share("quick_ratio", "速动比率", DEBT, "total_current_assets inventory total_current_liabilities", "{0} - {1}", "{2}")
share("cash_ratio", "货币资金比率", DEBT, "cash total_current_liabilities", "{0}", "{1}")
share("asset_turnover", "总资产周转率（期间）", TURNOVER, "revenue total_assets@open total_assets", "{0}", "({1} + {2}) / 2", "次")
for _code, _label, _flow, _stock in [("receivable_turnover", "应收账款周转", "revenue", "accounts_receivable"), ("inventory_turnover", "存货周转", "cost", "inventory")]:
    share(_code, f"{_label}率（期间）", TURNOVER, f"{_flow} {_stock}@open {_stock}", "{0}", "({1} + {2}) / 2", "次")
    add(f"{_code}_days", f"{_label}天数", TURNOVER, "天", f"{_flow} {_stock}@open {_stock}", "{r1}", ("{0}", "({1} + {2}) / 2"), ("{days}", "{r0}"), whole_months=True)
for _name, _label in [("revenue", "营业收入"), ("net_profit", "净利润"), ("net_profit_attributable_to_parent", "归母净利润"), ("total_assets", "总资产"), ("total_equity", "净资产"), ("total_liabilities", "总负债")]:
    growth(f"{_name}_growth", f"{_label}同比", _name, "prev")
growth(f"{OWN['parent_equity'][0]}_growth", "归母净资产同比", "parent_equity", "prev")
growth(f"{OWN['total_revenue'][0]}_growth", "营业总收入同比", "total_revenue", "prev")
share("cash_revenue", "销售收现比", CASH, "cash_received_from_sales revenue", "{0}", "{1}")
share("cash_profit", "净利润现金含量", CASH, "net_operating_cash_flow net_profit", "{0}", "{1}")
share("equity_multiplier", "权益乘数（平均余额）", DUPONT, "total_assets@open total_assets parent_equity@open parent_equity", "{0} + {1}", "{2} + {3}", "倍")
add("balance_difference", "资产负债表平衡差额", CHECK, "元", "total_assets total_liabilities total_equity", "{0} - {1} - {2}")
for _name, _label in [("total_assets", "总资产"), ("total_liabilities", "总负债"), ("total_equity", "净资产"), ("parent_equity", "归母净资产")]:
    growth(f"{OWN.get(_name, (_name,))[0]}_quarter_growth", f"{_label}环比", _name, "quarter")
add("roe", "净资产收益率(ROE)", PROFIT, "%", "reported_roe", "{0}")
add("reported_ex_roe", "扣非后加权净资产收益率(ROE)", PROFIT, "%", "reported_ex_roe", "{0}")
add("reported_ex_basic_eps", "扣非后基本每股收益", SHARE, "元/股", "reported_ex_basic_eps", "{0}")
add("reported_ex_diluted_eps", "扣非后稀释每股收益", SHARE, "元/股", "reported_ex_diluted_eps", "{0}")
for _part, _label, _name in [("", "", "net_profit_attributable_to_parent"), ("ex_", "扣非后", "net_profit_excluding_nonrecurring")]:
    share(f"roe_{_part}average", f"{_label}平均净资产收益率(ROE)", PROFIT, f"{_name} parent_equity parent_equity@open", "{0}", "({1} + {2}) / 2")
    share(f"roe_{_part}diluted", f"{_label}摊薄净资产收益率(ROE)", PROFIT, f"{_name} parent_equity", "{0}", "{1}")
for _code, _label, _name in [
    ("diluted_eps", "摊薄每股收益", "net_profit_attributable_to_parent"), ("net_assets_per_share", "每股净资产", "parent_equity"),
    ("cash_per_share", "每股经营现金流", "net_operating_cash_flow"), ("revenue_per_share", "每股营业收入", "revenue"),
    ("operating_per_share", "每股营业利润", "operating_profit"), ("cash_change_per_share", "每股现金流", "net_increase_in_cash"),
    ("capital_reserve_per_share", "每股资本公积金", "capital_reserve"), ("surplus_per_share", "每股盈余公积金", "surplus_reserve"),
    ("retained_per_share", "每股未分配利润", "retained_earnings"),
]:
    share(_code, _label, SHARE, f"{_name} ordinary_share_count", "{0}", "{1}", "元/股")
add("ebit", "EBIT", DEBT, "元", "total_profit interest", "{0} + {1}")
add("ebitda", "EBITDA", DEBT, "元", f"total_profit interest {AMORTISED}", added(0, 5))
share("ebit_cover", "EBIT保障倍数", DEBT, "total_profit interest", "{0} + {1}", "{1}", "倍")
share("ebitda_cover", "EBITDA保障倍数", DEBT, f"total_profit interest {AMORTISED}", added(0, 5), "{1}", "倍")
add("short_debt", "短期债务", DEBT, "元", SHORT, "{0} + {1}")
add("long_debt", "长期债务", DEBT, "元", LONG, added(0, 2))
add("interest_debt", "有息债务", DEBT, "元", f"{SHORT} {LONG}", added(0, 4))
share("debt_ebitda", "有息债务/EBITDA", DEBT, f"{SHORT} {LONG} total_profit interest {AMORTISED}", added(0, 4), added(5, 10), "倍")
for _code, _label, _name in [
    ("cost_rate", "营业成本率", "cost"), ("selling_rate", "营业费用率", "selling_expenses"), ("admin_rate", "管理费用率", "administrative_expenses"),
    ("research_rate", "研发费用率", "research_and_development_expenses"), ("finance_rate", "财务费用率", "finance_expenses"),
]:
    share(_code, _label, PROFIT, f"{_name} revenue", "{0}", "{1}")
share("expense_rate", "期间费用率", PROFIT, "selling_expenses administrative_expenses research_and_development_expenses finance_expenses revenue", added(0, 3), "{4}")
share("ebit_margin", "息税前利润率", PROFIT, "total_profit interest revenue", "{0} + {1}", "{2}")
share("ebitda_margin", "息税折旧摊销前利润率", PROFIT, f"total_profit interest {AMORTISED} revenue", added(0, 5), "{6}")
share("asset_reward", "总资产报酬率", PROFIT, "total_profit interest total_assets@open total_assets", "{0} + {1}", "({2} + {3}) / 2")
share("total_cost_rate", "营业总成本/营业总收入", PROFIT, "total_cost total_revenue", "{0}", "{1}")
share("current_asset_share", "流动资产/总资产", DEBT, "total_current_assets total_assets", "{0}", "{1}")
share("non_current_asset_share", "非流动资产/总资产", DEBT, "total_current_assets total_assets", "{1} - {0}", "{1}")
share("current_liability_share", "流动负债/总负债", DEBT, "total_current_liabilities total_liabilities", "{0}", "{1}")
share("non_current_liability_share", "非流动负债/总负债", DEBT, "total_current_liabilities total_liabilities", "{1} - {0}", "{1}")
share("equity_multiplier_end", "权益乘数", DEBT, "total_assets total_equity", "{0}", "{1}", "倍")
add("working_capital", "营运资金", DEBT, "元", "total_current_assets total_current_liabilities", "{0} - {1}")
share("conservative_quick", "保守速动比率", DEBT, "cash notes_receivable accounts_receivable total_current_liabilities", added(0, 2), "{3}")
share("cash_current_debt", "现金流动负债比率", DEBT, "net_operating_cash_flow total_current_liabilities", "{0}", "{1}", "倍")
share("cash_short_debt", "经营现金流量短期债务比", DEBT, f"net_operating_cash_flow {SHORT}", "{0}", added(1, 2), "倍")
share("cash_total_debt", "经营活动净现金/总负债", DEBT, "net_operating_cash_flow total_liabilities", "{0}", "{1}", "倍")
share("cash_interest_debt", "经营活动净现金/有息债务", DEBT, f"net_operating_cash_flow {SHORT} {LONG}", "{0}", added(1, 5), "倍")
share("cash_interest_cover", "现金流量利息保障倍数", DEBT, "net_operating_cash_flow interest", "{0}", "{1}", "倍")
share("cash_noncurrent_debt", "经营活动净现金/非流动负债", DEBT, "net_operating_cash_flow total_liabilities total_current_liabilities", "{0}", "{1} - {2}", "倍")
share("cash_net_debt", "经营活动净现金/净债务", DEBT, f"net_operating_cash_flow {SHORT} {LONG} cash", "{0}", f"{added(1, 5)} - {{6}}", "倍")
share("ebitda_debt", "EBITDA/有息债务", DEBT, f"total_profit interest {AMORTISED} {SHORT} {LONG}", added(0, 5), added(6, 10), "倍")
share("parent_capital_share", "归母净资产/投入资本", DEBT, f"parent_equity {SHORT} {LONG}", "{0}", added(0, 5))
share("debt_capital_share", "有息债务/投入资本", DEBT, f"parent_equity {SHORT} {LONG}", added(1, 5), added(0, 5))
share("current_asset_turnover", "流动资产周转率", TURNOVER, "revenue total_current_assets@open total_current_assets", "{0}", "({1} + {2}) / 2", "次")
share("fixed_asset_turnover", "固定资产周转率", TURNOVER, "revenue fixed_assets@open fixed_assets", "{0}", "({1} + {2}) / 2", "次")
for _name, _label in [("total_assets", "总资产"), ("total_liabilities", "总负债"), ("parent_equity", "归母净资产")]:
    growth(f"{OWN.get(_name, (_name,))[0]}_opening_growth", _label, _name, "open")
for _name, _label in [("total_profit", "利润总额"), ("operating_profit", "营业利润"), ("net_operating_cash_flow", "经营活动净现金"), ("basic_eps", "基本每股收益"), ("diluted_eps_reported", "稀释每股收益")]:
    growth(f"{OWN.get(_name, (_name,))[0]}_growth", _label, _name, "prev")
share("cash_sales_multiple", "销售收现比", CASH, "cash_received_from_sales revenue", "{0}", "{1}", "倍")
share("cash_profit_multiple", "净现比", CASH, "net_operating_cash_flow net_profit", "{0}", "{1}", "倍")
share("cash_revenue_multiple", "经营活动净现金/营业收入", CASH, "net_operating_cash_flow revenue", "{0}", "{1}", "倍")
add(
    "net_assets_per_share_growth", "每股净资产", GROWTH, "%", "parent_equity ordinary_share_count parent_equity@open ordinary_share_count@open",
    "{r2} * 100", ("{0}", "{1}"), ("{2}", "{3}"), ("{r0} - {r1}", "abs({r1})"),
)
_CYCLE = "revenue cost inventory@open inventory accounts_receivable@open accounts_receivable"
_PAYABLE = "cost inventory@open inventory accounts_payable@open accounts_payable"
add("operating_cycle", "营业周期", TURNOVER, "天", _CYCLE, "{days} * ({r0} + {r1})", ("({2} + {3}) / 2", "{1}"), ("({4} + {5}) / 2", "{0}"), whole_months=True)
share("payable_turnover", "应付账款周转率", TURNOVER, _PAYABLE, "{0} + {2} - {1}", "({3} + {4}) / 2", "次")
add("payable_days", "应付账款周转天数", TURNOVER, "天", _PAYABLE, "{r1}", ("{0} + {2} - {1}", "({3} + {4}) / 2"), ("{days}", "{r0}"), whole_months=True)
add(
    "cash_cycle", "现金周期", TURNOVER, "天", f"{_CYCLE} {_PAYABLE}", "{days} * ({r0} + {r1}) - {r3}",
    ("({2} + {3}) / 2", "{1}"), ("({4} + {5}) / 2", "{0}"), ("{6} + {8} - {7}", "({9} + {10}) / 2"), ("{days}", "{r2}"), whole_months=True,
)
