from __future__ import annotations

import random

from pyspark.sql import functions as F

from brightledger.operators import merging


def brute_groups(groups):
    done = []
    for g in groups:
        met = [x for x in done if x & set(g)]
        done = [x for x in done if not x & set(g)] + [set(g).union(*met)]
    return sorted(sorted(x) for x in done)


def brute_ends(sizes, budget):
    ends, held, start = [], 0, 0
    for i, s in enumerate(sizes):
        if held + s > budget and i > start:
            ends, held, start = [*ends, i], 0, i
        held += s
    return [*ends, len(sizes)] if sizes else []


def test_groups_that_share_a_member_become_one(spark):
    rng = random.Random(4)
    cases = [[], [[1]], [[1, 2], [3], [2, 3], [9, 9]]] + [[[rng.randint(1, 12) for _ in range(rng.randint(1, 3))] for _ in range(6)] for _ in range(20)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)] + [(99, None)], "id int, g array<array<int>>").select("id", merging.merged_groups(F.col("g")).alias("out"))
    found = {r["id"]: r["out"] for r in rows.collect()}
    assert found == {i: brute_groups(x) for i, x in enumerate(cases)} | {99: None}


def test_batches_keep_to_their_budget(spark):
    rng = random.Random(5)
    cases = [[], [5], [50], [5, 5, 1], [20, 3, 20], [0, 0]] + [[rng.randint(0, 14) for _ in range(15)] for _ in range(20)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "id int, s array<int>").select("id", merging.batch_ends(F.col("s"), 10).alias("out"))
    assert {r["id"]: r["out"] for r in rows.collect()} == {i: brute_ends(x, 10) for i, x in enumerate(cases)}


def test_fragments_in_order_with_nulls(spark):
    rows = [("a", 2, ["z"], ["i"], 7, 9), ("a", 1, ["x", "y"], ["i", "j"], 3, 5), ("b", 1, None, None, None, 1), (None, 1, ["q"], [], 1, 1)]
    out = merging.merged_fragments(spark.createDataFrame(rows, "k string, n int, items array<string>, issues array<string>, start_line int, end_line int"), ["k"], "n")
    assert {r["k"]: tuple(r)[1:] for r in out.collect()} == {"a": (["x", "y", "z"], ["i", "j"], 3, 9, 2), "b": ([], [], None, 1, 1), None: (["q"], [], 1, 1, 1)}
