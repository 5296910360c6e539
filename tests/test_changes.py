"""Stages by content, versions with concurrent writers, decisions, timers; generated code that compiles."""

from __future__ import annotations

import datetime as dt
import random
import threading
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import bench
from brightledger.operators import revisions, stages
from brightledger.plans.registry import QUERIES
from brightledger.sources import versions
from brightledger.streaming import events as streams
from brightledger.streaming import timers

# Versions ------------------------------------------------------------------------


def test_one_of_many_writers_wins(spark, tmp_path):
    folder, out = str(tmp_path / "t"), []
    versions.commit(spark.range(3), folder, 0)

    def write(i):
        try:
            out.append(("won", i, versions.commit(spark.range(i + 10), folder, 1, str(i))))
        except versions.VersionConflict as error:
            out.append(("lost", error.expected, error.current))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [o for o in out if o[0] == "won"]
    assert len(won) == 1 and won[0][2] == 2 and all(o[1:] == (1, 2) for o in out if o[0] == "lost") and len(out) == 6
    assert versions.version(spark, folder).count() == won[0][1] + 10
    assert versions.version(spark, folder, 1).count() == 3
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2 and not [p for p in (tmp_path / "t" / "drafts").iterdir() if p.suffix == ".json"]


def test_changes_of_all_writers_stay(spark, tmp_path):
    folder = str(tmp_path / "t")
    threads = [threading.Thread(target=versions.appended_once, args=(spark.range(10 * i, 10 * i + 15), folder, "id")) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in versions.version(spark, folder).collect()) == list(range(45))
    assert [r["revision"] for r in versions.history(spark, folder).orderBy("revision").collect()] == [1, 2, 3, 4]
    assert versions.appended_once(spark.range(40), folder, "id") == 5 and versions.version(spark, folder).count() == 45


def test_versions_before_the_first(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert versions.head(spark, folder) == 0 and versions.history(spark, folder).count() == 0
    with pytest.raises(LookupError):
        versions.version(spark, folder)
    with pytest.raises(versions.VersionConflict):
        versions.commit(spark.range(1), folder, 3)
    assert versions.commit(spark.range(0), folder, 0) == 1 and versions.version(spark, folder).count() == 0


def test_imports_are_a_fold(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.randrange(50), r.choice([0, 1, 2, 3, None])) for i in range(400)] + [(None, 900, 1, 0)]
    found = revisions.import_outcomes(spark.createDataFrame(rows, "project long, batch_id long, arrived long, expected_revision long"))
    now, expected = defaultdict(int), {}
    for project, batch, _, wish in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[2], x[1])):
        fits = wish == now[project]
        now[project] += fits
        expected[batch] = ("accepted" if fits else "fact_version_conflict", now[project])
    assert {x["batch_id"]: (x["outcome"], x["revision"]) for x in found.collect()} == expected
    current = {x["project"]: (x["revision"], x["batch_id"]) for x in revisions.current_batches(found).collect()}
    assert {p: v[0] for p, v in current.items()} == dict(now)
    assert all(b is None or expected[b] == ("accepted", v) for v, b in current.values())


# Decisions -----------------------------------------------------------------------


def test_decisions_fold_onto_the_version_of_their_time(spark):
    r = random.Random(7)
    items = [(i, v, r.randrange(30), r.choice(["source_verified", "source_value_not_found"])) for i in range(12) for v in range(r.randrange(1, 4))]
    decisions = [(n, r.randrange(14), r.randrange(40), r.choice(["confirm", "reject", "confirm", "maybe", None]), f"r{n}") for n in range(300)]
    now, told = revisions.decided(spark.createDataFrame(items, "item_id int, version int, made_at int, status string"), spark.createDataFrame(decisions, "decision_id int, item_id int, at int, decision string, reason string"))
    status, why, outcomes = {(i, v): s for i, v, _, s in items}, {}, {}
    for n, item, at, decision, reason in sorted(decisions, key=lambda d: (d[2], d[0])):
        made = [(m, v) for i, v, m, _ in items if i == item and m <= at]
        if decision not in ("confirm", "reject"):
            outcomes[n] = "invalid_decision"
        elif not made:
            outcomes[n] = "financial_item_not_found"
        elif decision == "confirm" and status[item, max(made)[1]] == "source_value_not_found":
            outcomes[n] = "source_value_not_found"
        else:
            outcomes[n] = "applied"
            status[item, max(made)[1]], why[item, max(made)[1]] = f"human_{decision}ed", reason
    newest = {i: max((m, v) for j, v, m, _ in items if j == i)[1] for i, *_ in items}
    assert {x["decision_id"]: x["outcome"] for x in told.collect()} == outcomes
    assert {x["item_id"]: (x["version"], x["status"], x["decision_reason"]) for x in now.collect()} == {i: (v, status[i, v], why.get((i, v))) for i, v in newest.items()}


# Stages --------------------------------------------------------------------------


def upper(due):
    return due.select("signature", F.upper("text").alias("response"), F.when(F.col("text").isNull(), "no_text").alias("error"))


def test_stage_runs_what_is_new(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    state = lambda df: [tuple(r) for r in df.orderBy("id").select("state", "response", "attempts", "reused", "last_error").collect()]
    run = lambda df, **k: stages.run_stage(df, folder, "upper", k.pop("version", "1"), upper, ["text"], **k)
    assert state(run(rows("a", "a", None))) == [("completed", "A", 1, False, None)] * 2 + [("failed", None, 1, False, "no_text")]
    assert state(run(rows("a", "b", None))) == [("completed", "A", 1, True, None), ("completed", "B", 1, False, None), ("failed", None, 2, False, "no_text")]
    assert state(run(rows(None)))[0][:3] == ("failed", None, 3) or state(run(rows(None)))[0][0] == "stage_attempt_limit_exceeded"
    assert state(run(rows(None)))[0][:3] == ("stage_attempt_limit_exceeded", None, 3)
    assert state(run(rows("a"), version="2")) == [("completed", "A", 1, False, None)]
    assert state(run(rows("a"), settings={"model": "m"})) == [("completed", "A", 1, False, None)]
    assert state(run(rows())) == []
    assert sorted(r["inputs"] for r in stages.work_done(spark, folder).collect()) == [1, 1, 1, 2, 2]


def test_lost_runs_are_charged_and_broken_results_are_not_used(spark, tmp_path):
    folder, rows = str(tmp_path / "s"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")

    def lost(due):
        raise RuntimeError("lost")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            stages.run_stage(rows, folder, "s", "1", lost, ["text"])
    assert {r["state"] for r in stages.cache_state(spark, folder).collect()} == {"pending"}
    done = stages.run_stage(rows.where("id = 1"), folder, "s", "1", upper, ["text"])
    assert [(r["state"], r["attempts"]) for r in done.collect()] == [("completed", 3)]
    spoilt = spark.read.parquet(f"{folder}/results").withColumn("response", F.lit("X"))
    spoilt.write.parquet(f"{folder}/spoilt")
    spark.read.parquet(f"{folder}/spoilt").write.mode("overwrite").parquet(f"{folder}/results")
    assert [r["state"] for r in stages.run_stage(rows.where("id = 1"), folder, "s", "1", upper, ["text"]).collect()] == ["stage_cache_invalid"]


# Timers --------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp, task_id long, action string"


def put(spark, folder, name, rows):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    spark.createDataFrame([(i, at(s), k, a) for i, s, k, a in rows], EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def run_leases(spark, folder):
    live = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    stream = timers.timed(live, "task_id", timers.Leases(), "10 seconds")
    timers.with_timers(spark, lambda: streams.write_once(stream, f"{folder}/out", f"{folder}/log"))
    rows = spark.read.schema(f"{timers.LEASE_OUT}, batch int").parquet(f"{folder}/out").collect()
    return sorted((r["task_id"], (r["at"] - dt.datetime(2024, 1, 1)).total_seconds(), r["what"], r["attempts"], r["batch"]) for r in rows)


def test_the_stream_itself_tells_when_a_lease_runs_out(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, "in1", [(1, 0, 1, "claim"), (2, 5, 2, "claim"), (3, 100, 2, "heartbeat"), (4, 6, 3, "heartbeat")])
    first = run_leases(spark, folder)
    assert [r[:4] for r in first] == [(1, 0.0, "claimed", 1), (2, 5.0, "claimed", 1)]
    put(spark, folder, "in2", [(5, 200, 9, "none")])  # another task's event moves the watermark to 190 s
    second = run_leases(spark, folder)
    assert [r[:4] for r in second] == [(1, 0.0, "claimed", 1), (1, 180.0, "lease_expired", 1), (2, 5.0, "claimed", 1)]
    put(spark, folder, "in3", [(6, 260, 1, "claim"), (7, 270, 2, "complete"), (8, 1000, 9, "none")])
    third = [r[:4] for r in run_leases(spark, folder)]
    assert third[2:] == [(1, 260.0, "claimed", 2), (1, 440.0, "lease_expired", 2), (2, 5.0, "claimed", 1), (2, 270.0, "completed", 1)]
    assert [r[:4] for r in run_leases(spark, folder)] == third
    assert spark.conf.get(timers.STORE, None) != timers.ROCKS


# Generated code ------------------------------------------------------------------


@pytest.mark.parametrize("name", [n for n in bench.HEADLINE if n in QUERIES])
def test_generated_code_compiles(spark, sf, name):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert QUERIES[name](spark, sf).count() >= 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


# Landed modules ------------------------------------------------------------------


def test_landed_modules_are_chosen_by_their_folders(spark, tmp_path):
    from brightledger.sources import provider_modules

    path = str(tmp_path / "landed")
    rows = [(m, c, r, f'{{"m": "{m}",\n "n": {n}}}') for m in ("a/b", "cash notes", "x") for c in ("CNY", "USD") for r in ("spot", "average") for n in range(2)]
    provider_modules.land(spark.createDataFrame(rows, "module_key string, currency string, rate string, payload string"), path)
    whole = provider_modules.landed_modules(spark, path)
    assert whole.count() == 24 and whole.rdd.getNumPartitions() == 3
    some = whole.where((F.col("module_key") == "a/b") & F.col("currency").isin("USD") & (F.col("payload").contains("1")))
    assert sorted((r["module_key"], r["currency"], r["rate"]) for r in some.collect()) == [("a/b", "USD", "average"), ("a/b", "USD", "spot")]
    assert some.rdd.getNumPartitions() == 1
    (tmp_path / "landed" / "module_key=x" / "currency=CNY" / "rate=spot" / "part-broken.txt").write_bytes(b"\xff\xfe")
    assert whole.where("module_key = 'x' AND currency = 'USD'").count() == 4  # what is ruled out isn't opened
    assert whole.where("module_key = 'none'").count() == 0
