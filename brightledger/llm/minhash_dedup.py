"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Every document with shingles gets a signature of K coordinates. A document is
posted under (coordinate, value) pairs, and two documents are candidates when
they collide on at least MATCHES pairs. Posting all pairs would make the postings
of a passage that many documents share long. Pairs are therefore ordered by how
many documents have them, the rarest first, and a document is posted under a
prefix only: two documents that collide on m of their pairs share one of the
first t - m + 1 pairs of each (t: pairs of the document that any other one has).
Documents with t < m are skipped. Candidates are then confirmed on the full sets.

Only classes of equal shingle sets are joined, and only what ties components
together is compared: first each posting list's members with its heaviest one, next
those that this leaves apart with the heaviest of them, then, in the lists that
still span several components, the pairs across these.
Such a list is cut into blocks, and pairs of blocks are compared in tasks of
their own, so that a long list is spread and emits only similar pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, saved, small_batches, spread_join, table
from .components import connected_components

#: Signature coordinates.
K = 64
#: Share of the pairs exactly at the threshold that may collide too seldom to become candidates.
MISSED = 1 / 200_000
#: Rounds in which a posting list's members are compared with one of them only.
STARS = 2
#: Shingles, and documents, in one block of a posting list.
BLOCK, BLOCK_ROWS = 400_000, 1000
#: Shingles whose signature values are held in memory at a time.
SLICE = 4096
#: Ids, of 8 bytes each, that are sent to every executor at most.
BROADCAST_IDS = 250_000
SEED = 20240229
#: Words whose hashes a worker remembers (some 3 MB).
KNOWN_WORDS = 20_000

_rng = np.random.default_rng(SEED)
MULTIPLY = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, K, dtype=np.uint64)
MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = WordHashes()


def matches(percent: int) -> int:
    """The collisions that make two documents candidates: all but MISSED of the pairs at the threshold have as many.

    At a similarity s the collisions are binomial: K draws of chance s. At 80 percent: 36 of 64.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    s, below = percent / 100, 0.0
    for m in range(K):
        below += math.comb(K, m) * s**m * (1 - s) ** (K - m)
        if below > MISSED:
            return max(m, 1)
    return K


def scrambled(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of two multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(hashed))
    mixed = np.full(len(hashed) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = scrambled(mixed * MIX[i % 16] + hashed[i : i + len(mixed)])
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of K hash functions, as signed 32-bit integers."""
    least = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), SLICE):
        part = shingles[None, i : i + SLICE] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(least, (part >> np.uint64(32)).astype(np.uint32).min(axis=1), out=least)
    return least.view(np.int32)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set, null if empty), sig (K ints, null if empty)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            sig = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.string()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, "doc_id long, n_shingles long, digest string, sig array<int>")


def shingle_sets(docs: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """node (the doc_id) and its sorted distinct shingle hashes, or the last 32 bits of them."""
    whole = bits == 64

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            sets = [s.view(np.int64) if whole else np.unique(s.astype(np.uint32).view(np.int32)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64() if whole else pa.int32()))], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, f"node long, shingles array<{'bigint' if whole else 'int'}>")


def prefix_posts(classes: DataFrame, least: int) -> DataFrame:
    """node, token, weight: the rarest pairs of each document, as many as the match threshold ``least`` needs.

    weight: how many documents have the document's pairs, all added up. It is largest
    for the document that a group's others were copied from.
    """
    tokens = classes.select("node", F.posexplode("sig").alias("at", "value")).select(
        "node", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(2**31)).alias("token")
    )
    shared = saved(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    own = spread_join(tokens, shared, "token", hot_keys(shared, "token"), "node")
    own = own.groupBy("node").agg(F.collect_list(F.struct("n", "token")).alias("own")).where(F.size("own") >= least)  # at most K
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    prefix = F.slice(F.array_sort("own"), F.lit(1), F.size("own") - (least - 1))
    return own.select("node", weight.alias("weight"), F.explode(prefix).alias("post")).select("node", "post.token", "weight")


def centred(members: DataFrame, long: DataFrame) -> DataFrame:
    """``members`` with their list's heaviest document (centre) and its component (own)."""
    centre = members.groupBy("token").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "component")).alias("c"))
    return spread_join(members, centre.select("token", (-F.col("c.minus")).alias("centre"), F.col("c.component").alias("own")), "token", long, "node")


def stars(members: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs of each posting list's heaviest member with the list's other ones of other components."""
    pairs = centred(members, long).where("component <> own")
    return pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def outside(members: DataFrame, long: DataFrame) -> DataFrame:
    """Members of each posting list that aren't in the component of its heaviest one."""
    return centred(members, long).where("component <> own").drop("centre", "own")


def placed(posts: DataFrame, component: DataFrame) -> DataFrame:
    """Posts with the component of their document, which is itself where it has no link."""
    return posts.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def collisions(a: str, b: str):
    """Coordinates on which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def having(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of the ids: by broadcast where these were counted to be few, else by a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, least: int) -> DataFrame:
    """The pairs (a, b) that collide often enough and whose full sets are similar enough."""
    pairs = saved(pairs)
    hubs = {end: hot_keys(saved(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))), end) for end in ("a", "b")}
    facts = classes.select("node", "n_shingles", "sig")
    left = facts.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = facts.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    near = (
        spread_join(spread_join(pairs, left, "a", hubs["a"], "b"), right, "b", hubs["b"], "a")
        .where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
        .where(collisions("sa", "sb") >= least)
        .select("a", "b", "na", "nb")
    )
    near = saved(near)
    wanted = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id"))).distinct()
    sets = saved(shingle_sets(having(docs.select("doc_id", "text"), wanted), size).dropDuplicates(["node"]))
    both = spread_join(near, sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b", hubs["b"], "a")
    both = spread_join(both, sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a", hubs["a"], "b")
    both = both.withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def agreeing(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of two sets of signatures (K, rows) that agree on ``least`` coordinates or more."""
    count = np.zeros((a.shape[1], b.shape[1]), np.uint8)
    low = a.astype(np.uint8), b.astype(np.uint8)  # the low bytes: where these differ often enough, so do the coordinates
    for k in range(K):
        count += low[0][k][:, None] == low[1][k][None]
    x, y = np.nonzero(count >= least)
    enough = np.empty(len(x), bool)
    for i in range(0, len(x), SLICE):
        s = slice(i, i + SLICE)
        enough[s] = (a[:, x[s]] == b[:, y[s]]).sum(axis=0) >= least
    return x[enough], y[enough]


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, least: int, long: DataFrame) -> DataFrame:
    """Similar pairs of one posting list whose ends are in different components.

    Of such a pair at least one document isn't in the component of the list's heaviest
    one, so these are held against the whole list. Both sides are dealt into blocks,
    bounded in shingles and rows, by a hash of the node, and every pair of blocks is a
    group of its own. A pair that meets in several lists is
    compared in the one with the smallest token. Documents that nothing links to a
    large component must be held against all of it, so pairs are compared on their
    sets where they meet and not given out before. Sets of 32-bit hashes serve for
    that: they can only raise the similarity, and what is given is confirmed later.
    """
    listed = centred(members, long).withColumn("outer", F.col("component") != F.col("own")).drop("centre", "own", "weight")
    listed = saved(listed.join(classes.select("node", "n_shingles"), "node"))
    blocks = lambda n, rows: F.ceil(F.greatest(F.sum(n) / BLOCK, F.sum(rows) / BLOCK_ROWS)).cast("int")
    outer, one = F.col("outer").cast("long"), F.lit(1)
    sizes = listed.groupBy("token").agg(blocks(outer * F.col("n_shingles"), outer).alias("few"), blocks(F.col("n_shingles"), one).alias("many")).where("few > 0")
    listed = spread_join(listed, saved(sizes), "token", long, "node")
    wanted = listed.select(F.col("node").alias("doc_id")).distinct()
    sets = shingle_sets(having(docs.select("doc_id", "text"), wanted), size, 32).dropDuplicates(["node"])
    own = listed.groupBy("node").agg(F.collect_list("token").alias("prefix"))
    facts = saved(own.join(classes.select("node", "sig"), "node").join(sets, "node"))
    own_block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sides = (
        listed.where("outer").select("token", "node", "component", "outer", "n_shingles", own_block("few").alias("i"), every_block("many").alias("j"), F.lit(True).alias("first"))
        .unionByName(listed.select("token", "node", "component", "outer", "n_shingles", every_block("few").alias("i"), own_block("many").alias("j"), F.lit(False).alias("first")))
    )
    dealt = sides.join(facts, "node")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        token = key[0].as_py()
        rows = rows.combine_chunks()
        sides = [rows.filter(rows["first"]), rows.filter(pc.invert(rows["first"]))]
        node, comp, n, outer = ([s[c].to_numpy() for s in sides] for c in ("node", "component", "n_shingles", "outer"))
        sig = [np.array(s["sig"].combine_chunks().flatten()).reshape(len(s), K).T for s in sides]
        x, y = agreeing(*sig, least)
        able = (comp[0][x] != comp[1][y]) & (100 * np.minimum(n[0][x], n[1][y]) >= percent * np.maximum(n[0][x], n[1][y]))
        able &= ~outer[1][y] | (node[0][x] < node[1][y])
        prefixes = [list(map(set, s["prefix"].to_pylist())) for s in sides]
        sets = [s["shingles"].combine_chunks() for s in sides]
        values, ends = [s.values.to_numpy() for s in sets], [s.offsets.to_numpy() for s in sets]
        joined: dict[int, int] = {}  # component -> one that a pair of this group ties it to

        def tied(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found: list[tuple[int, int]] = []
        for i, j in zip(x[able].tolist(), y[able].tolist(), strict=True):
            left, right = tied(int(comp[0][i])), tied(int(comp[1][j]))
            if left == right or min(prefixes[0][i] & prefixes[1][j]) != token:
                continue  # tied already, or compared elsewhere
            a, b = (v[e[k] : e[k + 1]] for v, e, k in zip(values, ends, (i, j), strict=True))
            common = len(np.intersect1d(a, b, assume_unique=True)) + n[0][i] - len(a)  # hashes that fell together count as common
            if 100 * common >= percent * (n[0][i] + n[1][j] - common):
                found.append((node[0][i], node[1][j]))
                sure = common - 8 - 16 * len(a) * len(b) / 2**32  # far more than hashes that fall together by chance
                if 100 * sure >= percent * (n[0][i] + n[1][j] - sure):
                    joined[max(left, right)] = min(left, right)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return dealt.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of word shingles are similar, directly or through others.

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their sets. Returns doc_id, n_shingles, component_id (the smallest doc_id
    reachable, itself included) and kept (doc_id = component_id), a row for each
    row of ``docs``. Null and empty texts, and texts of white space alone, have no
    shingles and are linked with nothing. A row without a doc_id is linked with
    nothing, has a null component and is kept. Ids are taken to be unique: rows
    that repeat an id and its text get equal values, and where texts of one id
    differ, each row follows its own text's class. Other columns are ignored, so their names can't clash; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    every = saved(signatures(docs, size))
    able = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes_of = saved(able.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    firsts = classes_of.groupBy("node").agg(F.min("digest").alias("digest")).select(F.col("node").alias("doc_id"), "digest")
    classes = saved(
        able.join(firsts, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sig").dropDuplicates(["node"])
    )
    least = matches(percent)
    posts = saved(prefix_posts(classes, least))
    long = saved(hot_keys(saved(posts.groupBy("token").agg(F.count(F.lit(1)).alias("n"))), "token"))
    links, part = None, None
    for step in range(STARS + 1):
        members = posts.withColumn("component", F.col("node")) if part is None else placed(posts, part)
        for _ in range(step if step < STARS else 0):
            members = outside(members, long)
        pairs = stars(members, long) if step < STARS else across(members, classes, docs, size, percent, least, long)
        new = saved(confirmed(pairs, classes, docs, size, percent, least))
        links = new if links is None else links.unionByName(new)
        part = saved(connected_components(links))
    component = classes_of.join(part, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    linked = spread_join(able.select("doc_id", "n_shingles", "digest"), component, "digest", hot_keys(classes_of, "digest"), "doc_id").drop("digest")
    rest = every.where(~F.coalesce(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.lit(False)))
    found = linked.unionByName(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all its columns.

    Null and empty texts are no duplicates of anything and stay, and so do rows
    without an id. Rows that share an id stay or go together: they stay where any of
    them is to be kept. An empty table gives an empty result; columns of any name
    beside doc_id and text are carried along untouched.
    """
    found = near_duplicates(docs, size, percent).where("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("stays")).where("NOT stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w),
cls AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sh WHERE len(s) > 0 GROUP BY 1),
one AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
pairs AS (SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM one a JOIN one b ON a.g = b.g AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
comp AS (SELECT rep, least(rep, coalesce((SELECT min(y) FROM reach WHERE reach.x = rep), rep)) AS c FROM cls)
SELECT sh.doc_id, CAST(len(sh.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sh.doc_id) AS component_id,
  sh.doc_id = coalesce(comp.c, sh.doc_id) AS kept
FROM sh LEFT JOIN cls ON list_sort(sh.s) = cls.s LEFT JOIN comp ON comp.rep = cls.rep
"""
