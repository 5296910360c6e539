"""Hubs, groups of copies, many lengths, rows without ids: results stay whole when hot keys are dealt out."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from brightledger.llm import common, components, exact_dedup, minhash_dedup, permutation_index, temperature_mix


def few_are_hot(monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_PART", 1 / 100)


def test_more_lengths_than_are_searched_together(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "LENGTHS", 4)
    rng = np.random.default_rng(3)
    rows = [(100 * d + i, rng.normal(size=d).tolist()) for d in range(1, 20) for i in range(5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = Counter((r["query_id"], r["vec_id"]) for r in permutation_index.nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10).collect())
    assert found == Counter({(100 * d, 100 * d + i): 1 for d in range(1, 20) for i in range(1, 5)})


def test_components_with_hubs(spark, monkeypatch):
    few_are_hot(monkeypatch)
    r = random.Random(5)
    edges = [(0, i) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(5000 + i, 5001 + i) for i in range(40)] + [(r.randrange(6000, 6300), r.randrange(6000, 6300)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_near_copies_of_a_hub_and_many_copies(spark, monkeypatch):
    few_are_hot(monkeypatch)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)]
    rows += [(100 + i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate([0, 1, 58, 59] * 10)]
    rows += [(500 + i, " ".join(r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(50))) for i in range(40)] + [(700, ""), (701, None), (None, " ".join(base))]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows if d is not None and t}
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    assert {x["doc_id"]: x["component_id"] for x in found if x["doc_id"] is not None} == {**{d: root(d) for d in sets}, 700: 700, 701: 701}
    assert len(found) == len(rows) and [x["component_id"] for x in found if x["doc_id"] is None] == [None]


def test_sums_before_buckets_are_running_sums(spark):
    r = random.Random(2)
    buckets = {(s, e, format(b, "03x")): r.randrange(100) for s in "ab" for e in (0, 1) for b in r.sample(range(4096), 300)}
    found = temperature_mix.totals_before(spark.createDataFrame([(*k, v) for k, v in buckets.items()] + [("c", 0, "", 7)], "_s string, epoch int, bucket string, held long"))
    before = {(x["_s"], x["epoch"], x["bucket"]): x["before"] for x in found.collect()}
    assert before == {**{(s, e, b): sum(v for (s2, e2, b2), v in buckets.items() if (s2, e2) == (s, e) and b2 < b) for s, e, b in buckets}, ("c", 0, ""): 0}


def test_rows_without_an_id_are_laid_out_once(spark):
    rows = [(i % 30, f"text {i % 30} " * 5, "s") for i in range(60)] + [(None, f"no id {i % 7}", "t" if i % 2 else None) for i in range(50)] + [(99, "long " * 50_000, "s")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = temperature_mix.mixed_documents(docs)
    assert found.columns == docs.columns
    texts = Counter(r["text"] for r in found.collect())
    assert all(texts[f"no id {k}"] == sum(t == f"no id {k}" for _, t, _ in rows) for k in range(7)) and texts["long " * 50_000] >= 1


def test_one_row_of_each_text_stays_with_its_own_columns(spark):
    rows = [(1, "a", "x", 1, "p"), (3, "a", "y", 2, "q"), (None, "a", "z", 3, "r"), (5, None, "e", 4, "s"), (4, "", "f", 5, "t"), (None, "b", "g", 6, "u"), (None, "b", "g", 6, "u"), (7, "c" * 300_000, "h", 7, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, row int, `t.x` string")
    for hash_of in (exact_dedup.content_hash, lambda t: F.lit("same")):
        found = exact_dedup.drop_copies(docs, hash_of)
        assert found.columns == docs.columns
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([rows[1], rows[3], rows[5], rows[7]], key=str)
    assert exact_dedup.drop_copies(docs.where("false")).count() == 0
