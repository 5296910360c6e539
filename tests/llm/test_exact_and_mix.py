from __future__ import annotations

import duckdb
import pytest
from parity import assert_parity, rows_of
from pyspark.sql import functions as F

from brightledger.llm import exact_dedup, licence_scan, queries, temperature_mix, tool_calls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op5_minhash_dedup"}))
def test_agrees_with_sql(spark, sf, name):
    assert_parity(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


ROWS = [(1, "a", "x"), (5, "a", "x"), (3, "a", "y"), (2, "b", None), (4, None, "y"), (6, "", "y"), (None, "c", "x"), (None, "a", "x"), (7, "long " * 5000, "x"), (8, "long " * 5000, "x")]


def test_exact_dedup_edges(spark):
    found = exact_dedup.exact_dedup(docs(spark, ROWS).withColumn("keep_id", F.lit(0)).withColumn("_h", F.lit("x"))).collect()
    by = {(r["doc_id"], r["group_size"]): (r["keep_id"], r["kept"]) for r in found}
    assert len(found) == len(ROWS) and by[1, 4] == (5, False) and by[5, 4] == (5, True) and by[4, 2] == (6, False) and by[None, 1] == (None, True) and by[None, 4] == (5, False) and by[7, 2] == (8, False)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_colliding_hashes_stay_apart(spark):
    every = docs(spark, ROWS)
    short = exact_dedup.exact_dedup(every, lambda text: F.substring(F.md5(text), 1, 1).substr(1, 0))
    assert rows_of(short.collect()) == rows_of(exact_dedup.exact_dedup(every).collect())


def test_drop_copies_keeps_one_of_each_text(spark):
    every = docs(spark, [*ROWS, (5, "a", "x")])
    kept = exact_dedup.drop_copies(every)
    assert kept.columns == every.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.select("doc_id", F.substring("text", 1, 3).alias("text")).collect()) == [(0, "c"), (2, "b"), (5, "a"), (6, ""), (8, "lon")]


MIX = [(i, "w " * (i % 17), f"s{min(i % 11, 3)}") for i in range(400)] + [(900, None, None), (901, "x y", None), (902, "x y", "s1")]


@pytest.fixture(scope="module")
def mixed(spark):
    return temperature_mix.temperature_mix(docs(spark, MIX), block_tokens=300).collect()


def test_mix_agrees_with_sql_on_small_blocks(spark, mixed):
    db = duckdb.connect()
    frame = docs(spark, MIX).toPandas()
    db.register("documents", frame)
    sql = temperature_mix.OP4_SQL.replace(f"whole / {temperature_mix.BLOCK_TOKENS}", "whole / 300")
    columns = "block, doc_id, epoch, slot, source, tokens"
    assert rows_of(db.sql(f"SELECT {columns} FROM ({sql})").fetchall()) == rows_of([tuple(r[c] for c in columns.split(", ")) for r in mixed])


def test_mix_keeps_every_document_and_its_limits(mixed):
    first = [r["doc_id"] for r in mixed if r["epoch"] == 0]
    assert sorted(first) == sorted(i for i, _, _ in MIX)
    own: dict[str, int] = {}
    for r in mixed:
        own[r["source"]] = own.get(r["source"], 0) + r["tokens"]
    size: dict[str, int] = {}
    for _, t, s in MIX:
        size[s or ""] = size.get(s or "", 0) + (t or "").count(" ") + 1
    assert all(own[s] <= temperature_mix.MOST_PASSES * size[s] + 20 for s in size) and own[""] > size[""]
    blocks: dict[int, list[int]] = {}
    for r in mixed:
        blocks.setdefault(r["block"], []).append(r["slot"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in blocks.values()) and len(blocks) > 3


def test_mix_edges(spark):
    assert temperature_mix.temperature_mix(docs(spark, [])).count() == 0
    assert [r["epoch"] for r in temperature_mix.temperature_mix(docs(spark, [(1, "a b", "s")])).collect()] == [0]
    with pytest.raises(ValueError):
        temperature_mix.temperature_mix(docs(spark, MIX), budget=10**9)
    half = temperature_mix.temperature_mix(docs(spark, MIX), budget=1000)
    assert 900 <= half.agg(F.sum("tokens")).first()[0] <= 1200
    assert temperature_mix.mixed_documents(docs(spark, [*MIX, (None, "q", "s1")])).select("doc_id").distinct().count() == len(MIX) + 1


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "note": ("string", False)}}
    calls = spark.createDataFrame(
        [("c", 1, "x", "add", '{"note":"n","a":1}', []), ("c", 2, "y", "add", '{"a":"1"}', ["x"]), ("c", 3, "z", "add", "[1]", ["y", "gone"]), ("c", 4, "u", "mul", "{}", ["v"]),
         ("c", 5, "v", "add", None, ["u"]), ("c", 1, "x", "add", '{"note":"n","a":1}', []), ("c", 9, None, "add", "{}", [])],
        "conv_id string, turn int, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("c", 4, "x", "ok"), ("c", 1, "y", "early"), ("c", 7, "w", None), ("c", 4, "x", "ok")], "conv_id string, turn int, call_id string, content string")
    found = {r["call_id"]: r for r in tool_calls.link_tool_calls(calls.withColumn("level", F.lit(9)), results, schemas).collect()}
    assert {k: (r["state"], r["level"], r["errors"]) for k, r in found.items()} == {
        "x": ("linked", 0, ""), "y": ("premature", 1, "not_integer:a"), "z": ("unanswered", 2, "arguments_not_object"), "u": ("unanswered", None, "unknown_tool"),
        "v": ("unanswered", None, "arguments_not_object"), "w": ("orphan", None, ""),
    }
    assert found["x"]["record"] == '{"arguments":{"a":1,"note":"n"},"id":"x","level":0,"name":"add","result":"ok","turn":1}'
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_levels_of_a_long_chain(spark):
    chain = [("c", str(i), [str(i - 1)] if i else []) for i in range(130)] + [("c", "p", ["q", "129"]), ("c", "q", ["p"])]
    calls = spark.createDataFrame(chain, "conv_id string, call_id string, depends_on array<string>").coalesce(1)
    assert {r["call_id"]: r["level"] for r in tool_calls.levels(calls).collect()} == {str(i): i for i in range(130)}


def test_call_ids_belong_to_their_conversation(spark):
    calls = spark.createDataFrame(
        [("a", 1, "1", "add", "{}", []), ("b", 3, "1", "add", '{"b":1}', ["0"]), ("b", 1, "0", "add", "{}", []), ("a", 5, "1", "add", '{"z":1}', ["1"]), (None, 1, "1", "add", "{}", [])],
        "conv_id string, turn int, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("b", 4, "1", "of b"), ("b", 6, "1", "again"), (None, 2, "1", "of none")], "conv_id string, turn int, call_id string, content string")
    rows = tool_calls.link_tool_calls(calls, results, {"add": {}}).collect()
    assert sorted(((r["conv_id"] or "", r["call_id"], r["turn"], r["state"], r["level"], r["result_turn"]) for r in rows), key=str) == sorted([
        ("a", "1", 1, "unanswered", 0, None), ("a", "1", 5, "repeated", None, None), ("b", "0", 1, "unanswered", 0, None), ("b", "1", 3, "linked", 1, 4), ("b", "1", 6, "repeated", None, 6), ("", "1", 1, "linked", 0, 2),
    ], key=str)
    assert {'"z":1', '"result":"again"'} <= {x for r in rows for x in ('"z":1', '"result":"again"') if x in r["record"] and r["state"] == "repeated"}


def test_every_turn_of_a_dialogue_has_a_row(spark):
    turns = [("c", 0, "system", "s"), ("c", 1, "user", "u"), ("c", 1, "user", "v"), ("c", 2, "assistant", "x"), ("c", 3, "tool", "t"), ("c", 4, "assistant", "y"), ("c", 5, None, "n")]
    messages = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    rows = tool_calls.link_tool_calls(*tool_calls.dialogue_calls(messages), tool_calls.DIALOGUE).collect()
    assert sorted((r["turn"], r["state"], r["errors"], r["result_turn"] or 0) for r in rows) == [
        (0, "unanswered", "", 0), (1, "linked", "", 2), (1, "repeated", "", 0), (3, "linked", "unknown_tool", 4), (5, "unanswered", "unknown_tool", 0)
    ]


def test_licences(spark):
    mit = licence_scan.KNOWN["MIT"][0]
    rows = [(1, f"Copyright (c) 2020 A. Person\n\n{mit.upper()}", None), (2, "text\n  released under the MIT licence!\nmore", None), (3, mit + " or not", None), (4, None, None), (5, "", None)]
    found = {r["doc_id"]: (r["document_licence"], r["line_licences"]) for r in licence_scan.licence_scan(docs(spark, rows).withColumn("text_digest", F.lit(1))).collect()}
    assert found == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, ""), 5: (None, "")}
    assert licence_scan.licence_scan(docs(spark, [])).count() == 0
