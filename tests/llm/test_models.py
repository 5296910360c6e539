from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from brightledger.llm import language_id, minhash_dedup, permutation_index, quality, sentencepiece_codec, toxicity
from brightledger.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    comp = {i: i for i, _ in rows}
    ids = sorted(comp)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared = [word() for _ in range(30)]
    rows, n = [], 0
    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = [w if rng.random() > 0.015 else word() for w in base]
            rows.append((n, " ".join((shared if rng.random() < 0.3 else []) + copy).replace("abc", "ABC")))
            n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "ONE  two\t"), (n + 4, " \n "), (n + 5, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_rows(seed)
    given = docs(spark, rows).withColumn("sig", F.lit(1)).withColumn("node", F.lit("x"))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(given, 4, 80).collect()}
    assert found == brute_components(rows, 4, 80)


def test_near_duplicates_edges(spark):
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    rows = minhash_dedup.near_duplicates(docs(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True)] * 2
    kept = minhash_dedup.drop_near_copies(docs(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f"), (3, None)]))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


TEXTS = ["", None, " ", "   ", "a", "  two  words ", "▁", "a▁b ▁", "tab\tand\nline\r\n feed\n", "\n\n x", "<s> </s> <unk>", "日本 語 😀", "\x00nul", "word " * 4000, "x" * 5000]


def test_sentencepiece_is_exact(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab ▁\n é漢") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    given = docs(spark, list(enumerate(texts)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_codec.sentencepiece_digests(given).collect()}
    for i, text in enumerate(texts):
        ids = model.encode(text or "")
        assert found[i] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids) if ids else "")), repr(text)[:50]
    back = sentencepiece_codec.sentencepiece_decode(sentencepiece_codec.sentencepiece_encode(given))
    assert {r["doc_id"]: r["text"] for r in back.collect()}[9] == model.decode(model.encode(texts[9]))
    assert sentencepiece_codec.sentencepiece_digests(docs(spark, [])).count() == 0


def accuracy(spark, sf, op, label, folds, out):
    data = f"{sf[:-5]}0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = op(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) and 0 <= r["score"] <= 1 for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return np.mean([a == b for a, b in held])


def test_quality_and_toxicity_on_held_out_documents(spark, sf):
    assert accuracy(spark, sf, quality.op2_quality, "quality", 5, 0) >= 0.95
    assert accuracy(spark, sf, toxicity.op10_toxicity, "toxic", 3, 1) >= 0.93


def test_classifiers_without_labels_and_with_odd_texts(spark):
    given = docs(spark, [(1, None), (2, ""), (None, "x"), (3, "long " * 30000)]).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(given, none).collect()} == {0.5}
    assert {r["predicted"] for r in quality.quality(given, none).collect()} == {1}
    assert toxicity.drop_toxic(given, none).columns == given.columns and toxicity.drop_toxic(given, none).count() == 4


def test_language_id(spark, sf):
    given = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34!", "en", "s", 0), (10**6 + 2, "", None, None, 0)], DOCS)
    rows = language_id.language_id(given.unionByName(odd)).collect()
    truth = {r["doc_id"]: r["lang"] for r in given.collect()}
    held = [truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(held) >= 0.93
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] >= 10**6} == {("und", 0.0)}
    assert {r["lang_pred"] for r in language_id.language_id(odd.where("lang IS NULL")).collect()} == {"und"}


def test_language_gradients():
    net = language_id.untrained(["a", "b"])
    rng = np.random.default_rng(0)
    codes, real, label = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.ones((5, 4), np.float32), np.array([0, 1, 1, 0])
    real[3:, 1] = 0
    loss, found = language_id.gradients(net, codes, real, label)
    for p, g in zip(net.parameters(), found, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = p[at].copy()
        p[at] = kept + 1e-2
        up = language_id.gradients(net, codes, real, label)[0]
        p[at] = kept - 1e-2
        down = language_id.gradients(net, codes, real, label)[0]
        p[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 0.03 * abs(g[at]) + 1e-3


def test_permutation_index_recall_and_edges(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found: dict[int, list[int]] = {}
    for r in permutation_index.op1_permutation_index(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(np.sqrt(((x[ids == r["vec_id"]][0] - x[ids == r["query_id"]][0]) ** 2).sum()) - r["score"]) < 1e-12
    hits = 0
    for q, near in found.items():
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        hits += len(set(near) & set([i for i in ids[np.lexsort((ids, away))] if i != q][:10]))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 9 * len(found)


def test_permutation_index_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 2.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0], 1), (None, [1.0, 1.0], 1), (3, [0.0, 2.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = permutation_index.nearest_neighbours(vectors, vectors.where("vec_id IN (0, 4, 5)"), 2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]
    assert permutation_index.nearest_neighbours(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    given = spark.read.parquet(f"{sf}/documents.parquet")
    step, before = given, None
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, step, sf)
        assert after.columns == given.columns
        before, step = step.collect(), spark.createDataFrame(after.collect(), given.schema)
        texts = {r["doc_id"]: r["text"] for r in before}
        kept = sorted({r["doc_id"] for r in step.collect()})
        if name == "toxicity":
            clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
            assert len(clean & set(kept)) >= 0.97 * len(clean)  # too few labels here to catch the toxic ones
        elif name == "exact_dedup":
            last: dict[str, int] = {}
            for i, t in texts.items():
                last[t or ""] = max(i, last.get(t or "", -1))
            assert kept == sorted(last.values())
        elif name == "near_dedup":
            brute = brute_components(sorted(texts.items()), 5, 80)
            assert kept == sorted(i for i, (_, c) in brute.items() if c == i)
        else:
            assert kept == sorted(texts) and len(step.collect()) >= len(before)
    assert corpus_pipeline.STAGES[4][1](spark, step, sf).count() == step.count()


def test_planted_toxic_documents_are_caught(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(900):
        words, toxic = [word() for _ in range(rng.randint(5, 80))], int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(["wretchgob", "gobsludge", "sludgewretch"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(toxic, found[i]["predicted"]) for i, _, toxic in labels if found[i]["held_out"]]
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 0.02 * len(held)


def test_quality_reads_texts_without_spaces_to_their_end(spark):
    features = quality.token_grams()
    for start in ("漢字，かな。" * 20, "aB3+" * 30, "x" * 50):
        assert features(start + "!!") != features(start) and features(start + ";a;") != features(start + "a;;")
        assert quality.Shapes().pieces(start) and "".join(quality.Shapes().pieces(start)) == quality.Shapes()[start]
    assert features("one\ttwo\u3000three") >= features("one\ttwo") and (hash_of := quality.Grams()[("a",)]) in features("a" * 30 + "1\tword\t2") and hash_of not in features("1\t2")
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 2
        line = "".join(rng.choice("天地玄黃宇宙洪荒") * rng.randint(1, 9) + rng.choice("，、") for _ in range(40))
        rows.append((i, line + ("" if good else "%%%") + line[: rng.randint(1, 99)]))
        labels.append((i, good, 0))
    found = {r["doc_id"]: r for r in quality.quality(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [good == found[i]["predicted"] for i, good, _ in labels if found[i]["held_out"]]
    assert len(held) > 40 and np.mean(held) >= 0.9
