"""Accounting identities: signed sums of disclosed values within their disclosed precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DECIMAL, unit_scale

#: Statement type -> check -> concept -> coefficient. Fixed values.
CHECKS = {
    "balance_sheet": {
        "assets_equal_liabilities_equity": {"total_assets": 1, "total_liabilities": -1, "total_equity": -1},
        "current_plus_noncurrent_assets_equal_assets": {"total_current_assets": 1, "total_noncurrent_assets": 1, "total_assets": -1},
        "current_plus_noncurrent_liabilities_equal_liabilities": {"total_current_liabilities": 1, "total_noncurrent_liabilities": 1, "total_liabilities": -1},
    },
    "income_statement": {
        "profit_less_tax_equals_net_profit": {"total_profit": 1, "income_tax_expense": -1, "net_profit": -1},
        "operating_plus_nonoperating_equals_total_profit": {"operating_profit": 1, "nonoperating_income": 1, "nonoperating_expense": -1, "total_profit": -1},
    },
    "cash_flow_statement": {
        "cash_flows_plus_fx_equal_net_increase": {"net_operating_cash_flow": 1, "net_investing_cash_flow": 1, "net_financing_cash_flow": 1, "exchange_rate_effect": 1, "net_increase_in_cash": -1},
        "opening_cash_plus_change_equals_ending_cash": {"beginning_cash_balance": 1, "net_increase_in_cash": 1, "ending_cash_balance": -1},
    },
}


def statement_checks(items: DataFrame, statement: list[str], checks: dict[str, dict[str, dict[str, int]]] = CHECKS) -> DataFrame:
    """Evaluate the identities of every statement.

    ``items``: the columns ``statement`` (its key), statement_type, concept, value,
    raw_unit, source_increment, status and mapping_state. Returns the key, code,
    status, difference, tolerance and missing_concepts, a row for each statement and
    check of its type. An input is usable where it is the only candidate, verified,
    mapped and has a value and a precision; equal repeats aren't usable. The
    tolerance is half of the inputs' smallest steps in yuan. Nothing is changed. All
    checks of a statement come from one pass over its items.
    """
    concepts = sorted({c for of in checks.values() for terms in of.values() for c in terms})
    usable = (F.col("status") == "source_verified") & (F.col("mapping_state") == "mapped") & F.col("value").isNotNull() & F.col("source_increment").isNotNull() & unit_scale(F.col("raw_unit")).isNotNull()
    ready = items.withColumn("_usable", F.coalesce(usable, F.lit(False))).withColumn("_step", (F.col("source_increment").cast("decimal(18,8)") * unit_scale(F.col("raw_unit"))).cast(DECIMAL))
    own = lambda c, x: F.when(F.col("concept") == c, x)
    facts = [x for i, c in enumerate(concepts) for x in (F.count(own(c, F.lit(1))).alias(f"n{i}"), F.bool_and(own(c, F.col("_usable"))).alias(f"u{i}"), F.max(own(c, F.col("value").cast(DECIMAL))).alias(f"v{i}"), F.max(own(c, F.col("_step"))).alias(f"s{i}"))]
    wide = ready.groupBy(*statement, "statement_type").agg(*facts)

    def outcome(code: str, terms: dict[str, int]) -> Column:
        at = {c: concepts.index(c) for c in terms}
        good = reduce(lambda x, y: x & y, [(F.col(f"n{i}") == 1) & F.coalesce(f"u{i}", F.lit(False)) for i in at.values()])
        missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(c)) for c, i in at.items()])))
        difference, tolerance = (reduce(lambda x, y: x + y, xs) for xs in ([F.col(f"v{at[c]}") * k for c, k in terms.items()], [F.col(f"s{i}") / F.lit(2) for i in at.values()]))
        return F.struct(F.lit(code).alias("code"), missing.alias("missing_concepts"), good.alias("all_good"), difference.cast(DECIMAL).alias("difference"), tolerance.cast(DECIMAL).alias("tolerance"))

    by_type = F.coalesce(*[F.when(F.col("statement_type") == t, F.array(*[outcome(code, terms) for code, terms in of.items()])) for t, of in checks.items()])
    done = wide.select(*statement, "statement_type", F.explode(by_type).alias("x")).select(*statement, "statement_type", "x.*")
    status = (
        F.when(F.size("missing_concepts") > 0, "not_checked_missing_disclosure").when(~F.col("all_good"), "not_checked_unverified_source")
        .when(F.abs("difference") <= F.col("tolerance"), "passed").otherwise("conflict")
    )
    checked = F.col("status").isin("passed", "conflict")
    return done.withColumn("status", status).select(
        *statement, "statement_type", "code", "status", F.when(checked, F.col("difference")).alias("difference"), F.when(checked, F.col("tolerance")).alias("tolerance"), "missing_concepts"
    )
