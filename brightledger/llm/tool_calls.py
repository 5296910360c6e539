"""Tool-call linking: calls joined to results, ordered, validated, serialised (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Tool -> field -> (kind, required). Kinds are those of JSON values.
Schemas = dict[str, dict[str, tuple[str, bool]]]
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
#: Levels in one table of those found; more are written together, so that plans stay short.
LEVELS_APART = 50


def schema_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted faults of a call's arguments (a variant) against its tool's schema."""
    kind = F.schema_of_variant(arguments)
    faults = [F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), "unknown_tool"), F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "arguments_not_object")]
    for tool, fields in schemas.items():
        for field, (wanted, required) in fields.items():
            own = F.schema_of_variant(F.try_variant_get(arguments, f"$['{field}']", "variant"))
            absent = own.isNull() | (own == "VOID")
            mine = (name == tool) & kind.startswith("OBJECT")
            if required:
                faults.append(F.when(mine & absent, f"missing:{field}"))
            faults.append(F.when(mine & ~absent & ~own.rlike(f"^{KINDS[wanted]}$"), f"not_{wanted}:{field}"))
    return F.array_sort(F.array_compact(F.array(*faults)))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: 0 for a call without known dependencies, else one more than its deepest one.

    One level is found a round, by a join of what is still open with the ids that
    were just placed, until a round places nothing. Calls of a cycle, and behind one,
    get no row. A dependency that names no call of its conversation is passed over.
    """
    return levels_by_key(calls.select(F.struct("conv_id", "call_id").alias("key"), "depends_on")).select("key.conv_id", "key.call_id", "level")


def levels_by_key(calls: DataFrame) -> DataFrame:
    """``levels`` of calls given by their key; a structure, so that a null conv_id is a conversation like any other."""
    ids = calls.select("key")
    edges = saved(
        calls.select("key", F.explode(F.array_distinct("depends_on")).alias("on"))
        .select("key", F.struct(F.col("key.conv_id"), F.col("on").alias("call_id")).alias("on"))
        .join(ids.withColumnRenamed("key", "on"), "on", "left_semi")
    )
    placed = saved(ids.join(edges.select("key").distinct(), "key", "left_anti").withColumn("level", F.lit(0)))
    whole, level = placed, 0
    while not edges.isEmpty():
        level += 1
        left = edges.join(placed.select(F.col("key").alias("on")), "on", "left_anti")
        done = edges.select("key").distinct().join(left.select("key").distinct(), "key", "left_anti")
        placed = saved(done.withColumn("level", F.lit(level)))
        if placed.isEmpty():
            break
        edges = saved(left)
        whole = whole.unionByName(placed)
        if level % LEVELS_APART == 0:
            whole = saved(whole)
    return whole


def standing(rows: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame | None]:
    """key, r: the smallest row of each key, and the further ones that differ from it, if there are any."""
    rows = rows.where("call_id IS NOT NULL").select(F.struct("conv_id", "call_id").alias("key"), F.struct(*cols).alias("r"))
    found = saved(rows.groupBy("key").agg(F.min("r").alias("r"), (F.min("r") != F.max("r")).alias("several")))
    first = found.select("key", "r")
    if found.where("several").isEmpty():
        return first, None
    return first, rows.distinct().join(first, ["key", "r"], "left_anti")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link every call to its result, place it in topological order and check it.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and depends_on
    (ids of calls of the conversation that must come first); ``results`` has conv_id,
    turn, call_id and content. An id belongs to its conversation: the same call_id in
    another one is another call. Returns conv_id, turn, call_id, state, level, errors,
    result_turn and record, a row for each call, for each result without a call and
    for each further row of a key:

    state: linked, unanswered (no result), premature (the result's turn isn't later),
    orphan (a result without a call) or repeated (see below). level: sorting a
    conversation by (level, turn) is a topological order; null for an orphan, a
    repeated row, a call of a cycle or behind one. errors: sorted, joined by commas,
    empty for a valid call. record: canonical JSON, with sorted keys and no white
    space; arguments that aren't JSON are null.

    Of several rows with one (conv_id, call_id) the one with the smallest (turn, name,
    arguments, depends_on), or (turn, content), stands, so that repeated ids can't
    multiply; every other one that differs from it is a row of its own with state
    repeated, unlinked: a call with its arguments or a result with its content. Rows
    that are alike in all these columns are one row; rows with a null id are passed
    over. Other columns are ignored. Empty tables give no rows.
    """
    asked, more_asked = standing(calls, "turn", "name", "arguments", "depends_on")
    given, more_given = standing(results, "turn", "content")
    level = levels_by_key(asked.select("key", "r.depends_on"))
    joined = asked.withColumnRenamed("r", "c").join(given.withColumnRenamed("r", "g"), "key", "full").join(level, "key", "left").withColumn("again", F.lit(False))
    for further, name in ((more_asked, "c"), (more_given, "g")):
        if further is not None:
            joined = joined.unionByName(further.withColumnRenamed("r", name).withColumn("again", F.lit(True)), allowMissingColumns=True)
    return linked(joined, schemas)


def linked(joined: DataFrame, schemas: Schemas) -> DataFrame:
    """What ``link_tool_calls`` returns, of key, call (c), result (g), level and whether the row repeats a key (again)."""
    is_call = F.col("c").isNotNull()
    turn, result_turn = F.col("c.turn"), F.col("g.turn")
    state = (
        F.when(F.col("again"), "repeated").when(~is_call, "orphan").when(F.col("g").isNull(), "unanswered")
        .when(result_turn <= turn, "premature").otherwise("linked")
    )
    value = F.try_parse_json("c.arguments")
    faults = F.when(is_call, schema_errors(F.col("c.name"), value, schemas)).otherwise(F.array().cast("array<string>"))
    record = F.to_json(
        F.struct(value.alias("arguments"), F.col("key.call_id").alias("id"), "level", F.col("c.name").alias("name"), F.col("g.content").alias("result"), F.coalesce(turn, result_turn).alias("turn")),
        {"ignoreNullFields": "false"},
    )
    return joined.select(
        F.col("key.conv_id").alias("conv_id"), F.coalesce(turn, result_turn).alias("turn"), F.col("key.call_id").alias("call_id"),
        state.alias("state"), "level", F.array_join(faults, ",").alias("errors"), result_turn.alias("result_turn"), record.alias("record"),
    )


#: What a turn of a plain dialogue is as a call.
DIALOGUE: Schemas = {"system": {"text": ("string", True)}, "user": {"text": ("string", True)}}


def dialogue_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain dialogues (conv_id, turn, role, text).

    A turn is a call of the tool of its role with its text as the argument, named
    ``conv_id:turn``, but for an assistant turn, which is the result of the call one
    turn before. A user turn depends on its conversation's system turn 0. Turns of
    other roles than system and user, or of none, are calls of an unknown tool.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    given = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    calls = given.where("role IS DISTINCT FROM 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.col("role").alias("name"),
        F.to_json(F.struct("text"), {"ignoreNullFields": "false"}).alias("arguments"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), F.array(name(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = given.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*dialogue_calls(table(spark, sf_dir, "conversations")), DIALOGUE)


OP3_SQL = """
WITH m AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id || ':' || turn AS call_id, min({'conv_id': conv_id, 'turn': turn, 'name': role, 'text': text}) AS r
  FROM m WHERE role IN ('system', 'user') GROUP BY 1),
g AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min({'conv_id': conv_id, 'turn': turn, 'text': text}) AS r FROM m WHERE role = 'assistant' GROUP BY 1),
j AS (
  SELECT coalesce(c.call_id, g.call_id) AS call_id, coalesce(c.r.conv_id, g.r.conv_id) AS conv_id, coalesce(c.r.turn, g.r.turn) AS turn,
    c.r.name AS name, c.r.text AS asked, g.r.turn AS result_turn, g.r.text AS result, c.call_id IS NOT NULL AS is_call,
    CASE WHEN c.call_id IS NULL THEN NULL
      WHEN c.r.name = 'user' AND c.r.turn > 0 AND EXISTS (SELECT 1 FROM c z WHERE z.call_id = c.r.conv_id || ':0') THEN 1 ELSE 0 END AS level
  FROM c FULL JOIN g ON c.call_id = g.call_id)
SELECT conv_id, turn, call_id,
  CASE WHEN NOT is_call THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' WHEN result_turn <= turn THEN 'premature' ELSE 'linked' END AS state,
  level::INTEGER AS level, CASE WHEN is_call AND asked IS NULL THEN 'missing:text' ELSE '' END AS errors, result_turn,
  '{"arguments":' || CASE WHEN is_call THEN '{"text":' || coalesce(to_json(asked)::VARCHAR, 'null') || '}' ELSE 'null' END
  || ',"id":' || to_json(call_id)::VARCHAR || ',"level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"turn":' || turn || '}' AS record
FROM j
"""
