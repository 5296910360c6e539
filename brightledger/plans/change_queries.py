"""Queries of what changes: stages that are recomputed by content, versions of tables and facts, decisions, timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import revisions, stages
from ..sources import versions
from ..sources.readers import table
from ..streaming import events as streams
from ..streaming import timers
from .registry import query

# Stages --------------------------------------------------------------------------


def _lines(due):
    """A stage: lines and bytes of a text; texts of one line have no response."""
    n = F.size(F.split("text", "\n"))
    response = F.when(n > 1, F.to_json(F.struct(n.alias("lines"), F.octet_length("text").alias("bytes"))))
    return due.select("signature", response.alias("response"), F.when(n == 1, "no_line_break").alias("error"))


_LINES = "CASE WHEN contains(text, chr(10)) THEN '{\"lines\":' || (len(text) - len(replace(text, chr(10), '')) + 1) || ',\"bytes\":' || strlen(text) || '}' END"


@query(f"""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'changed' ELSE text END AS text, text AS was FROM documents),
 o AS (SELECT DISTINCT text FROM documents)
 SELECT n.doc_id, coalesce(contains(n.text, chr(10)) AND o.text IS NOT NULL, false) AS reused, {_LINES.replace('text', 'n.text')} AS response,
  CASE WHEN contains(n.text, chr(10)) THEN 'completed' ELSE 'failed' END AS state, 1 + CASE WHEN o.text IS NOT NULL AND NOT contains(n.text, chr(10)) THEN 1 ELSE 0 END AS attempts
 FROM n LEFT JOIN o ON n.text = o.text""")
def stage_recompute(spark, d):
    """After a seventh of the documents has changed, only texts that are new, and the failures, are worked out again."""
    docs, folder = table(spark, d, "documents").select("doc_id", "text"), streams.scratch(spark)
    stages.run_stage(docs, folder, "lines", "1", _lines, ["text"])
    after = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text")))
    return stages.run_stage(after, folder, "lines", "1", _lines, ["text"]).select("doc_id", "reused", "response", "state", "attempts")


@query("""WITH t AS (SELECT count(DISTINCT text) AS n, count(DISTINCT text) FILTER (NOT contains(text, chr(10))) AS failing FROM documents)
 SELECT * FROM (VALUES (1), (2), (3)) AS v(place), LATERAL (SELECT CASE place WHEN 1 THEN n ELSE failing END AS inputs FROM t)""")
def stage_attempt_budget(spark, d):
    """Inputs of each of four runs of one stage: all, then those that fail, until their attempts are used up."""
    docs, folder = table(spark, d, "documents").select("text"), streams.scratch(spark)
    for _ in range(4):
        stages.run_stage(docs, folder, "lines", "1", _lines, ["text"])
    done = stages.work_done(spark, folder)
    ordered = done.orderBy(F.desc("inputs"), "run").limit(4).toPandas()  # a row for each run
    return spark.createDataFrame([(i + 1, int(n)) for i, n in enumerate(ordered["inputs"])], "place int, inputs long")


# Versions ------------------------------------------------------------------------

_BATCHES = """b AS (SELECT o_custkey AS project, o_orderkey AS batch_id, o_orderdate AS arrived, o_orderkey % 4 AS expected,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
 r(project, n, batch_id, fits, revision) AS (SELECT DISTINCT project, 0::BIGINT, NULL::BIGINT, false, 0::BIGINT FROM b UNION ALL
  SELECT b.project, b.n, b.batch_id, b.expected = r.revision, r.revision + CASE WHEN b.expected = r.revision THEN 1 ELSE 0 END FROM r JOIN b ON b.project = r.project AND b.n = r.n + 1)"""


def _outcomes(spark, d):
    batches = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderdate").alias("arrived"), (F.col("o_orderkey") % 4).alias("expected_revision"))
    return revisions.import_outcomes(batches)


@query("WITH RECURSIVE " + _BATCHES + " SELECT project, batch_id, CASE WHEN fits THEN 'accepted' ELSE 'fact_version_conflict' END AS outcome, revision FROM r WHERE n > 0")
def import_outcomes(spark, d):
    return _outcomes(spark, d).select("project", "batch_id", "outcome", "revision")


@query("WITH RECURSIVE " + _BATCHES + """, c AS (SELECT project, max(revision) AS revision, max(batch_id) FILTER (fits AND revision = m) AS batch_id, count(*) FILTER (NOT fits) AS conflicts
   FROM (SELECT *, max(revision) OVER (PARTITION BY project) AS m FROM r WHERE n > 0) GROUP BY project)
 SELECT project, revision, conflicts, count(l_orderkey) AS facts, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
 FROM c LEFT JOIN lineitem ON l_orderkey = batch_id GROUP BY 1, 2, 3""")
def current_facts(spark, d):
    """The facts of each project are those of its last accepted batch."""
    own = revisions.current_batches(_outcomes(spark, d))
    facts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.count(F.lit(1)).alias("facts"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    return own.join(facts, "batch_id", "left").select("project", "revision", "conflicts", F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce(F.col("total"), F.lit(0)).cast("double").alias("total"))


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS writer, 3 AS revision, 1 AS conflicts FROM customer")
def snapshot_commits(spark, d):
    """Two writers from one revision: one wins; the other works its change out anew on what the first one left."""
    folder = streams.scratch(spark)
    start = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit("none").alias("writer"))
    versions.commit(start, folder, 0, "start")
    first, second = versions.version(spark, folder, 1), versions.version(spark, folder, 1)
    conflicts = 0
    versions.commit(first.withColumn("writer", F.lit("first")), folder, 1, "first")
    mark = lambda now: now.withColumn("writer", F.when(F.col("c_custkey") % 3 == 0, "second").otherwise(F.col("writer")))
    try:
        versions.commit(mark(second), folder, 1, "second")
    except versions.VersionConflict:
        conflicts += 1
        versions.changed(spark, folder, mark, "second")
    return versions.version(spark, folder).withColumn("revision", F.lit(versions.head(spark, folder))).withColumn("conflicts", F.lit(conflicts))


# Decisions -----------------------------------------------------------------------

_DECIDED = """i AS (SELECT o_custkey AS item_id, o_orderkey AS version, o_orderdate AS made_at, o_totalprice AS value,
   CASE o_orderstatus WHEN 'F' THEN 'source_verified' WHEN 'O' THEN 'source_value_not_found' ELSE 'needs_confirmation' END AS status FROM orders),
 e AS (SELECT event_id AS decision_id, user_id AS item_id, CAST(to_timestamp(epoch_us(TIMESTAMP '1995-01-01') / 1e6 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 * 80) AT TIME ZONE 'UTC' AS TIMESTAMP) AS at_,
   CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'view' THEN 'confirm' WHEN 'click' THEN 'reject' ELSE event_type END AS decision FROM events),
 p AS (SELECT e.*, (SELECT max({'m': i.made_at, 'v': i.version}) FROM i WHERE i.item_id = e.item_id AND i.made_at <= e.at_).v AS version FROM e),
 q AS (SELECT p.*, i.status AS given, min(CASE WHEN decision = 'reject' THEN {'t': at_, 'd': decision_id} END) OVER (PARTITION BY p.item_id, p.version) AS rejected
   FROM p LEFT JOIN i ON i.item_id = p.item_id AND i.version = p.version),
 o AS (SELECT *, CASE WHEN decision NOT IN ('confirm', 'reject') THEN 'invalid_decision' WHEN version IS NULL THEN 'financial_item_not_found'
   WHEN decision = 'confirm' AND given = 'source_value_not_found' AND coalesce({'t': at_, 'd': decision_id} < rejected, true) THEN 'source_value_not_found' ELSE 'applied' END AS outcome FROM q)"""


def _decided(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "source_verified").when(F.col("o_orderstatus") == "O", revisions.NOT_FOUND).otherwise("needs_confirmation")
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("timestamp").alias("made_at"), F.col("o_totalprice").alias("value"), status.alias("status"))
    made = T.lookup(F.col("event_type"), {"purchase": "confirm", "view": "confirm", "click": "reject"})
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    at = F.timestamp_micros(F.unix_micros(F.lit("1995-01-01").cast("timestamp")) + micros * 80)  # a month of events over the years of the orders
    decisions = table(spark, d, "events").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("item_id"), at.alias("at"), F.coalesce(made, F.col("event_type")).alias("decision"), F.lit("").alias("reason"))
    return revisions.decided(items, decisions)


@query("WITH " + _DECIDED + " SELECT decision_id, item_id, version, outcome FROM o")
def decision_outcomes(spark, d):
    return _decided(spark, d)[1].select("decision_id", "item_id", "version", "outcome")


@query("WITH " + _DECIDED + """, l AS (SELECT item_id, version, max_by(decision, {'t': at_, 'd': decision_id}) AS decision, count(*) AS decisions FROM o WHERE outcome = 'applied' GROUP BY 1, 2),
 n AS (SELECT item_id, max_by(version, {'m': made_at, 'v': version}) AS version FROM i GROUP BY 1),
 s AS (SELECT i.*, CASE decision WHEN 'confirm' THEN 'human_confirmed' WHEN 'reject' THEN 'human_rejected' ELSE status END AS final, coalesce(decisions, 0) AS decisions
   FROM n JOIN i USING (item_id, version) LEFT JOIN l USING (item_id, version))
 SELECT c_nationkey, final AS status, count(*) AS items, CAST(sum(decisions) AS BIGINT) AS decisions, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (final <> 'human_rejected') AS DOUBLE) AS total
 FROM s JOIN customer ON c_custkey = item_id GROUP BY 1, 2""")
def decided_totals(spark, d):
    """Sums over items after the decisions on them: rejected items count nothing."""
    items = _decided(spark, d)[0].join(table(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), "c_nationkey"), "item_id")
    total = F.sum(F.when(F.col("status") != revisions.REJECTED, F.col("value").cast("decimal(18,2)"))).cast("double")
    return items.groupBy("c_nationkey", "status").agg(F.count(F.lit(1)).alias("items"), F.sum("decisions").alias("decisions"), total.alias("total"))


# Timers --------------------------------------------------------------------------

_FASTER = 600
_TICKS = f"""e AS (SELECT user_id AS task_id, event_id, epoch_us(ts) // {_FASTER * 1000} AS ms, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // {_FASTER * 1000}, event_id) AS n FROM events),
 w AS (SELECT max(ms) - 60000 AS ms FROM e)"""


def _fast(spark, d):
    """The stream of events, with a month told in 72 minutes."""
    live = streams.event_stream(spark, f"{d}/event[s].parquet")
    return live.withColumn("ts", F.timestamp_millis(F.floor(F.unix_millis("ts") / _FASTER).cast("long")))


def _run(spark, stream, schema):
    folder = streams.scratch(spark)
    timers.with_timers(spark, lambda: streams.write_once(stream, f"{folder}/out", f"{folder}/log"))
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out").drop("batch")


@query("WITH RECURSIVE " + _TICKS + """,
 r(task_id, n, ms, s0, a0, u0, event_type, state, attempts, until) AS (SELECT DISTINCT task_id, 0::BIGINT, 0::BIGINT, 'queued', 0, 0::BIGINT, '', 'queued', 0, 0::BIGINT FROM e UNION ALL
  SELECT task_id, n, ms, before, attempts, until, event_type,
   CASE WHEN event_type = 'view' AND s = 'queued' THEN 'running' WHEN event_type = 'purchase' AND s = 'running' THEN 'completed' WHEN event_type = 'signup' AND s = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE s END,
   attempts + CASE WHEN event_type = 'view' AND s = 'queued' THEN 1 ELSE 0 END, CASE WHEN event_type IN ('view', 'click') AND ((event_type = 'view' AND s = 'queued') OR (event_type = 'click' AND s = 'running')) THEN ms + 180000 ELSE until END
  FROM (SELECT e.*, r.state AS before, r.attempts, r.until, CASE WHEN r.state = 'running' AND r.until < e.ms THEN CASE WHEN r.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE r.state END AS s FROM r JOIN e ON e.task_id = r.task_id AND e.n = r.n + 1)),
 z AS (SELECT task_id, max_by(state, n) AS state, max_by(attempts, n) AS attempts, max_by(until, n) AS until FROM r GROUP BY 1),
 x AS (SELECT task_id, u0 AS ms, a0 AS attempts FROM r WHERE s0 = 'running' AND u0 < ms UNION ALL SELECT task_id, z.until, attempts FROM z, w WHERE state = 'running' AND z.until <= w.ms)
 SELECT task_id, CAST(ms AS BIGINT) AS ms, CASE WHEN attempts >= 3 THEN 'retry_limit_exceeded' ELSE 'lease_expired' END AS what, attempts FROM x
 UNION ALL SELECT task_id, ms, CASE event_type WHEN 'view' THEN 'claimed' WHEN 'purchase' THEN 'completed' ELSE CASE WHEN state = 'failed' THEN 'failed' ELSE 'requeued' END END, attempts FROM r
 WHERE (event_type = 'view' AND state = 'running' AND (s0 = 'queued' OR (s0 = 'running' AND u0 < ms))) OR (event_type IN ('purchase', 'signup') AND s0 = 'running' AND u0 >= ms)""")
def stream_lease_expiry(spark, d):
    """Leases of tasks over a live stream; the stream itself says when one runs out."""
    action = T.lookup(F.col("event_type"), {"view": "claim", "click": "heartbeat", "purchase": "complete", "signup": "fail"})
    live = _fast(spark, d).select(F.col("user_id").alias("task_id"), "event_id", "ts", F.coalesce(action, F.lit("none")).alias("action"))
    out = _run(spark, timers.timed(live, "task_id", timers.Leases(), "60 seconds"), timers.LEASE_OUT)
    return out.select("task_id", F.unix_millis("at").alias("ms"), "what", "attempts")


@query("WITH RECURSIVE " + _TICKS + """,
 r(user_id, n, ms, event_type, f0, u0, what, failures, since, until) AS (SELECT DISTINCT task_id, 0::BIGINT, 0::BIGINT, '', 0, 0::BIGINT, '', 0, 0::BIGINT, 0::BIGINT FROM e UNION ALL
  SELECT task_id, n, ms, event_type, f0, u0, CASE WHEN until > 0 THEN 'login_rate_limited' WHEN event_type = 'purchase' THEN 'ok' ELSE 'invalid_credentials' END,
   CASE WHEN until > 0 THEN failures WHEN event_type = 'purchase' THEN 0 ELSE failures + 1 END, CASE WHEN until > 0 OR failures > 0 THEN since ELSE ms END,
   CASE WHEN until > 0 THEN until WHEN event_type <> 'purchase' AND failures + 1 >= 5 THEN ms + 300000 ELSE 0 END
  FROM (SELECT e.*, r.failures AS f0, r.until AS u0, CASE WHEN r.until > 0 THEN CASE WHEN r.until < e.ms THEN 0 ELSE r.failures END WHEN r.failures > 0 AND r.since + 300000 < e.ms THEN 0 ELSE r.failures END AS failures, r.since,
    CASE WHEN r.until > 0 AND r.until >= e.ms THEN r.until ELSE 0 END AS until FROM r JOIN e ON e.task_id = r.user_id AND e.n = r.n + 1)),
 z AS (SELECT user_id, max_by(failures, n) AS failures, max_by(until, n) AS until FROM r GROUP BY 1)
 SELECT user_id, ms, what, CAST(CASE WHEN what = 'ok' THEN coalesce(p, 0) ELSE failures END AS INTEGER) AS failures FROM (
  SELECT *, CASE WHEN lag(until) OVER o > 0 THEN 0 WHEN lag(failures) OVER o > 0 AND lag(since) OVER o + 300000 < ms THEN 0 ELSE lag(failures) OVER o END AS p FROM r WINDOW o AS (PARTITION BY user_id ORDER BY n)) WHERE n > 0
 UNION ALL SELECT user_id, u0, 'unblocked', f0 FROM r WHERE u0 > 0 AND u0 < ms UNION ALL SELECT user_id, until, 'unblocked', failures FROM z, w WHERE until > 0 AND until <= w.ms""")
def stream_login_window(spark, d):
    """Login attempts over a live stream: windows of failures that reset, blocks that are lifted by timers."""
    live = _fast(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("valid"))
    out = _run(spark, timers.timed(live, "user_id", timers.Logins(), "60 seconds"), timers.LOGIN_OUT)
    return out.select("user_id", F.unix_millis("at").alias("ms"), "what", "failures")


@query("""SELECT strftime(to_timestamp(s * 900) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n
 FROM (SELECT event_type, unnest(range(epoch_us(ts) // 900000000 - 3, epoch_us(ts) // 900000000 + 1)) AS s FROM events) GROUP BY 1, 2""")
def stream_live_sliding(spark, d):
    """Counts of the last hour, every quarter of an hour, over a live stream."""
    folder = streams.scratch(spark)
    streams.write_once(streams.sliding(streams.event_stream(spark, f"{d}/event[s].parquet")), f"{folder}/out", f"{folder}/log", "update")
    out = spark.read.schema("window_start timestamp, event_type string, n long, batch int").parquet(f"{folder}/out")
    last = out.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))  # a later batch updates a window
    return last.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")
