"""Brute-force versions of the fitted models, and the cases that once went wrong."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brightledger.llm import exact_dedup, language_id, licence_scan, minhash_dedup, nbsvm, permutation_index, quality, sentencepiece_codec, temperature_mix, toxicity
from brightledger.llm.common import hot_keys, spread_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def labelled(n=240, seed=3):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % 2
    rows = [np.unique(np.concatenate([rng.integers(0, 60, 12), rng.integers(100 + 40 * y, 140 + 40 * y, 6)])).astype(np.int32) for y in label]
    return rows, label


def test_log_count_ratios_are_counted_shares():
    rows, label = labelled()
    found = nbsvm.log_count_ratios(rows, label)
    counts = [{}, {}]
    for r, y in zip(rows, label, strict=True):
        for f in r.tolist():
            counts[y][f] = counts[y].get(f, 0) + 1
    seen = set(counts[0]) | set(counts[1])
    whole = [sum(c.values()) + len(seen) for c in counts]
    for f in seen:
        p, q = counts[1].get(f, 0) + 1, counts[0].get(f, 0) + 1
        ratio = math.log(p / whole[1] / (q / whole[0]))
        assert found[f] == pytest.approx(ratio if abs(ratio) >= nbsvm.LEAST_ERRORS * math.sqrt(1 / p + 1 / q) else 0.0)


def test_dual_descent_finds_the_minimum_of_a_dense_solver():
    rows, label = labelled()
    values = nbsvm.log_count_ratios(rows, label)
    w, bias = nbsvm.dual_descent(rows, values, label, nbsvm.LOSS, 400)
    used = np.flatnonzero(values)
    x = np.zeros((len(rows), len(used) + 1))
    for i, r in enumerate(rows):
        x[i, :-1] = np.where(np.isin(used, r), values[used], 0)
    x[:, -1] = 1
    sign, cost = np.where(label == 1, 1.0, -1.0), nbsvm.LOSS / len(rows)
    loss = lambda v: 0.5 * v @ v + cost * np.maximum(0, 1 - sign * (x @ v)).sum()
    v, best = np.zeros(x.shape[1]), np.inf
    for t in range(1, 6000):  # subgradients of the primal problem
        inside = sign * (x @ v) < 1
        v = v - (v - cost * (sign[inside, None] * x[inside]).sum(0)) / (t + 10)
        best = min(best, loss(v))
    assert loss(np.append(w[used], bias)) == pytest.approx(best, rel=2e-3)


def scalar_probabilities(net, raw):
    """The network, a byte and a unit at a time, over windows with their context."""
    u, total = language_id.UNITS, np.zeros(len(net.languages))
    clip = lambda x, low: min(max(x, low), 1.0)
    for start in range(0, len(raw), language_id.READ):
        low, high = max(0, start - language_id.CONTEXT), min(len(raw), start + language_id.READ + language_id.CONTEXT)
        states = np.zeros((high - low, 2 * u))
        for side in (0, 1):
            h = [0.0] * u
            for t in range(low, high) if side == 0 else range(high - 1, low - 1, -1):
                x = net.inputs[side][:, raw[t]]
                a = [sum(net.recur[side][k, j] * h[j] for j in range(u)) for k in range(3 * u)]
                z, r = ([clip(x[o + k] + a[o + k], 0.0) for k in range(u)] for o in (0, u))
                n = [clip(x[2 * u + k] + r[k] * a[2 * u + k], -1.0) for k in range(u)]
                h = [z[k] * h[k] + (1 - z[k]) * n[k] for k in range(u)]
                states[t - low, side * u : (side + 1) * u] = h
        for t in range(start, min(start + language_id.READ, len(raw))):
            e = np.exp(net.out @ states[t - low] + net.bias[:, 0])
            total += e / e.sum()
    return total / len(raw)


def test_network_reads_whole_texts_like_a_scalar_loop():
    net = language_id.untrained(["de", "en", "fr"])
    texts = [b"x", bytes(range(256)) + "häuser und so".encode(), b"", b"abc" * 50]
    found = language_id.document_probabilities(net, texts)
    for text, row in zip(texts, found, strict=True):
        if text:
            assert row == pytest.approx(scalar_probabilities(net, text), abs=2e-5)
    assert found[2].sum() == 0


def test_training_windows_hold_every_byte():
    label, codes, real = language_id.windows_of([(0, b"a" * 100), (1, b"b" * 60), (1, b"")])
    assert real.sum() == 160 and label.tolist() == [0, 0, 1] and codes[:40, 1].tolist() == [97] * 40


def test_numerals_are_no_letters(spark):
    assert not language_id.has_letter("½ ٣ 12") and language_id.has_letter("12 é")
    assert language_id.language_id(docs(spark, [])).count() == 0


def test_permutation_index_on_many_segments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(2)
    found = permutation_index.nearest_neighbours(vectors, vectors.where("vec_id % 400 = 0"), 10).collect()
    hits = 0
    for q in range(0, len(x), 400):
        away = np.sqrt(((x - x[q]) ** 2).sum(1))
        away[q] = np.inf
        mine = [r for r in found if r["query_id"] == q]
        assert len(mine) == 10 and all(r["score"] == pytest.approx(away[r["vec_id"]], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(away, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * len(found)
    segments = [4096] * 4 + [20_000 - 4 * 4096]
    assert sum(permutation_index.reranked(n, 10) for n in segments) + permutation_index.PIVOTS < 0.1 * len(x)


def test_permutation_index_edges(spark):
    rng = np.random.default_rng(2)
    far = 1e6 + 1e-3 * rng.normal(size=(90, 8))
    rows = [(i, v) for i, v in enumerate(far.tolist())] + [(200, [1.0, 2.0]), (201, [1.0, 3.0]), (202, [0.0, 0.0]), (203, None), (204, [1.0, float("nan")]), (205, []), (None, [1.0, 1.0]), (206, [9.0] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    found = permutation_index.nearest_neighbours(vectors, vectors, 3).collect()
    for q in range(0, 90, 7):
        away = np.sqrt(((far - far[q]) ** 2).sum(1))
        away[q] = np.inf
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == np.argsort(away, kind="stable")[:3].tolist()
    assert {(r["query_id"], r["vec_id"], r["score"]) for r in found if r["query_id"] >= 200} == {(200, 201, 1.0), (201, 200, 1.0)}
    blocks = spark.createDataFrame([(2, 0, [1], [1.0, 2.0], [0])], permutation_index.BLOCK_SCHEMA)
    segments = spark.createDataFrame([(2, [i], [1.0, 2.0], [0], [0], [0, 1]) for i in range(40)], permutation_index.SEGMENT_SCHEMA)
    held, permutation_index.BROADCAST_BYTES = permutation_index.BROADCAST_BYTES, 1
    try:
        assert permutation_index.met(segments, blocks.unionByName(blocks.withColumn("qids", F.array(F.lit(2).cast("long"))))).count() == 80
    finally:
        permutation_index.BROADCAST_BYTES = held


def test_copies_are_told_by_text_where_ids_repeat(spark):
    kept = exact_dedup.drop_copies(docs(spark, [(5, "a"), (5, "b"), (9, "b"), (7, None), (7, ""), (None, "c"), (None, "c"), (None, "b")]).withColumn("_sha", F.lit(1)))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("5", "a"), ("7", ""), ("9", "b"), ("None", "c")]
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def test_hot_keys_are_dealt(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").where("k < 2 OR id < 50")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, "k")
    assert {r["k"] for r in hot.collect()} == {0, 1}
    assert spread_join(rows, sizes, "k", hot, "id").count() == rows.count()


def test_licences_in_other_scripts(spark):
    mit = "Released under the MIT License."
    found = licence_scan.licence_scan(docs(spark, [(1, "这是一个软件 " + mit), (2, mit), (2, mit), (3, "这"), (4, "那"), (5, None)])).orderBy("doc_id").collect()
    assert [r["document_licence"] for r in found] == [None, "MIT", "MIT", None, None, None] and len({r["text_digest"] for r in found}) == 5
    apache = next(t for t in licence_scan.KNOWN["Apache-2.0"] if len(t) > 5000)
    whole = licence_scan.licence_scan(docs(spark, [(1, "Copyright 2020 Somebody\n" + apache.upper().replace(".", " . "))])).first()
    assert whole["document_licence"] == "Apache-2.0"


@pytest.mark.parametrize("percent", [50, 80])
def test_matches_follow_the_threshold(percent):
    s, least = percent / 100, minhash_dedup.matches(percent)
    chance = lambda m: math.comb(64, m) * s**m * (1 - s) ** (64 - m)
    assert sum(map(chance, range(least))) <= minhash_dedup.MISSED < sum(map(chance, range(least + 1)))
    with pytest.raises(ValueError):
        minhash_dedup.matches(0)


def test_agreeing_signatures():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (64, 30), dtype=np.int32) * 256, rng.integers(0, 4, (64, 40), dtype=np.int32) * 256
    b[:40, 3] = a[:40, 5]
    x, y = minhash_dedup.agreeing(a, b, 24)
    assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(30) for j in range(40) if (a[:, i] == b[:, j]).sum() >= 24}


@pytest.mark.parametrize(("score", "count"), [(quality.quality, 4), (toxicity.toxicity, 4)])
def test_classifier_edges(spark, score, count):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = "word " * 60_000
    given = docs(spark, [(1, long), (1, long), (None, None), (2, "")]).withColumn("score", F.lit("x"))
    rows = score(given, labels).collect()
    assert len(rows) == count and {r["score"] for r in rows} == {0.5} and score(docs(spark, []), labels).count() == 0


def test_stages_take_any_columns_and_empty_tables(spark, sf):
    clash = docs(spark, [(1, "one two three"), (None, None), (2, "")]).select("*", F.lit(1).alias("_toxicity_score"), F.lit(2).alias("_epoch"), F.lit(3).alias("_at"), F.lit(4).alias("n_shingles"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (clash, clash.limit(0)):
            out = stage(spark, given, sf)
            n = out.count()
            assert n == 0 if given is not clash else n >= 2
            assert name == "sentencepiece" or out.columns == given.columns


def test_mixture_is_laid_out_in_blocks(spark):
    rows = spark.createDataFrame([(i, "a b c", "en", "x" if i % 4 else "y", 5) for i in range(400)], DOCS)
    out = temperature_mix.mixed_documents(rows, block_tokens=300)
    assert {r["doc_id"] for r in out.collect()} == set(range(400)) and [r["doc_id"] for r in out.limit(50).collect()] != list(range(50))


def test_codec_ignores_other_columns(spark):
    given = docs(spark, [(1, "a b"), (1, "a b")]).withColumn("n_tokens", F.lit("x")).withColumn("ids_sha256", F.lit(1))
    assert sentencepiece_codec.sentencepiece_digests(given).distinct().count() == 1
