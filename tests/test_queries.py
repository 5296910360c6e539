"""Every registered query runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import pytest
from parity import assert_parity

import __spark_entry__ as entry  # registers all queries
from brightledger.plans.registry import EXAMPLES, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert_parity(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_example_agrees_with_its_rows(spark, sf, name):
    run, sql = EXAMPLES[name]
    assert_parity(run(spark, sf), sql, sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["entity", "scope", "document_id", "period", "value", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_module_values_cover_every_scope(spark, sf):
    from brightledger.plans import facts

    found = QUERIES["module_values"](spark, sf).where("value IS NOT NULL").select("module_key", "row_key", "period_raw", "value").collect()
    wide = facts.wide(spark, sf).collect()
    key = lambda r: "/".join([r["entity"], r["scope"], r["document_id"]])
    assert sorted((r["module_key"], r["row_key"], r["period_raw"], r["value"]) for r in found) == sorted((key(r), c, str(r["start"]), str(r[c])) for r in wide for c in ("revenue", "cost"))
    assert {k.split("/")[1] for k, *_ in found} == {"consolidated", "parent", "unknown"}
