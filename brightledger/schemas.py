"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

#: One disclosed value with its dimensions and state.
STATEMENT_FACT = (
    "statement_id string, item_id string, document_id string, statement_type string, entity string, scope string, currency string, "
    "period_start date, period_end date, period_kind string, period_raw string, concept string, source_name string, raw_value string, raw_unit string, "
    "value decimal(28,8), status string, statement_state string, issues array<string>, unit_known boolean"
)
#: A value typed in by hand, with its evidence.
MANUAL_FACT = "concept string, value string, entity string, scope string, period date, currency string, unit string, line int, quote string"
#: A cell of an extraction benchmark, expected or found, with its source anchor.
BENCHMARK_CELL = (
    "document_id string, company_id string, table_id string, source_row int, source_column int, statement_type string, scope string, period string, currency string, "
    "unit_scale string, concept string, source_name string, value string, verification_state string"
)
#: A provider's module: periods and rows of values in their order.
MODULE = (
    "module_key string, category string, currency string, rate string, periods array<string>, "
    "rows array<struct<key:string,name:string,unit:string,level:int,values:array<string>>>"
)
