"""The prefix trie of conversations, by collapsing equal whole sequences.

A conversation is a sequence of turns. Equal sequences are grouped first, into one
sequence with a weight and the list of conversations that end there; sequences that are
proper prefixes of another one are told by an anti-join, the rest are the leaves; what
a node of the trie holds is a sum over the prefixes of weighted sequences and of leaves.

Texts leave the first scan as digests. A prefix is named by its length and the sum of
128-bit digests of (place, turn) over its turns, so that running sums, which can be cut
into blocks, name all prefixes of a conversation of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_keys, saved, small_batches, spread_join, table

#: A family is so many consecutive ids; its first conversation lends up to HEADS - 1 turns to each of them.
FAMILY, HEADS = 5, 9
#: Turns in one block of running sums, conversation ids in one block of an end list.
BLOCK, ENDS = 1024, 4096
LANES = ["l0", "l1", "l2", "l3"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and bytes of each turn, saved.

    Rows are ordered by (conv_id, turn, role, digest) over range partitions, so that a
    long conversation lies in many tasks; a turn's place is its number within its
    partition after the turns of its conversation in the partitions before.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["turn", "role", "digest"]
    dealt = saved(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    within = dealt.withColumn("place", F.row_number().over(W.partitionBy("conv_id", "part").orderBy(*order)).cast("long"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return saved(within.join(before, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("place"), "digest", "bytes"))


def lanes(place: Column, digest: Column) -> list[Column]:
    """A 128-bit digest of a turn at its place, as four numbers of 32 bits, whose sums don't overflow below 2^31 turns."""
    whole = F.md5(F.concat_ws(":", place, digest))
    return [F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("long").alias(name) for i, name in enumerate(LANES)]


def name_of(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth, *sums))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, bytes and lanes of the turns of every conversation, rebuilt on the first one of its family; depth 0 stands for the start. Saved."""
    count = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).groupBy(F.col("conv_id").alias("base"))
    heads = first.agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("turns"))  # at most HEADS - 1
    shape = count.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), lent.alias("lent")).join(heads, "base", "left")
    head = F.slice(F.coalesce("turns", F.array().cast("array<struct<place:bigint,digest:string,bytes:bigint>>")), F.lit(1), F.col("lent").cast("int"))
    shape = saved(shape.select("conv_id", "n", head.alias("head")))
    start = shape.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    given = shape.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.bytes")
    own = spread_join(turns.where(F.col("place") > lent), shape.select("conv_id", F.size("head").alias("given")), "conv_id", hot_keys(shape, "conv_id"), "place")
    own = own.select("conv_id", (F.col("place") - lent + F.col("given")).alias("depth"), "digest", "bytes")
    zero = F.col("depth") == 0
    sums = [F.when(zero, 0).otherwise(c).alias(name) for c, name in zip(lanes(F.col("depth"), F.col("digest")), LANES, strict=True)]
    return saved(start.union(given).union(own).select("conv_id", "depth", "bytes", *sums))


def prefixes(rows: DataFrame, per_sequence: list[str]) -> DataFrame:
    """rep, depth, bytes, upto (bytes as far as there), node, parent and ``per_sequence`` of every prefix of the sequences in ``rows``. Saved."""
    added = [*LANES, "bytes"]
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    within = W.partitionBy("rep", "block").orderBy("depth")
    earlier = W.partitionBy("rep").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("rep", "block").agg(*[F.sum(c).alias(c) for c in added])
    before = blocks.select("rep", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in added])
    upto = rows.select("*", *[F.sum(c).over(within).alias(f"{c}_within") for c in added]).join(before, ["rep", "block"])
    sums = {c: F.col(f"{c}_within") + F.col(f"{c}_before") for c in added}
    parent = name_of(F.col("depth") - 1, [sums[c] - F.col(c) for c in LANES])
    return saved(
        upto.select(
            "rep", "depth", "bytes", sums["bytes"].alias("upto"), name_of(F.col("depth"), [sums[c] for c in LANES]).alias("node"),
            F.when(F.col("depth") > 0, parent).alias("parent"), *per_sequence,
        )
    )


def end_lists(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: the digest of the ids in (node, conv_id), ascending, joined by commas.

    The ids of one node may be a large part of all: range partitions write them as runs
    of at most ENDS ids, and only the digest, which can't be cut, reads the runs of a
    node one after the other. No list is held whole.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        told: list[tuple[str, int, str]] = []
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (n != node or len(ids) == ENDS):
                    told.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*told, strict=True)], names=["node", "first", "ids"])
                told = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        told: list[tuple[str, str]] = []
        for batch in batches:
            for n, run in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n != node:
                    if digest is not None:
                        told.append((node, digest.hexdigest()))
                    node, digest = n, hashlib.sha256(run.encode())
                else:
                    digest.update(b"," + run.encode())
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*told, strict=True)], names=["node", "ends_sha256"])
                told = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    small_batches(ends.sparkSession)
    cut = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(runs, "node string, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Turns
    are ordered by turn, null first, then by role and by digest of role and text; rows
    that agree in all of these are turns of their own. Null role or text counts as
    empty; rows without a conv_id take no part. Every conversation c is rebuilt: the
    first h turns of the conversation c - c % FAMILY, as far as there are, then its own
    turns after its first h, with h = crc32(c) % HEADS. A conversation may have no turn
    left; it is a member of the root alone.

    Returns a row for each node, a distinct sequence of first turns: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the nodes below and itself: members but one, times the bytes of
    the last text), ends_sha256 (of the members with no further turn), and node and
    parent, the names. Of an empty table there is no node, not even the root.
    """
    rows = rebuilt(turns_of(conversations))
    wholes = rows.groupBy("conv_id").agg(F.max("depth").alias("turns"), F.sum("bytes").alias("total"), *[F.sum(c).alias(c) for c in LANES])
    wholes = saved(wholes.select("conv_id", "turns", "total", name_of(F.col("turns"), [F.col(c) for c in LANES]).alias("node")))
    sequences = saved(wholes.groupBy("node", "turns", "total").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))

    long_ones = hot_keys(wholes, "conv_id", "turns")
    once = spread_join(rows, sequences.select(F.col("rep").alias("conv_id"), "turns", "total", "weight"), "conv_id", long_ones, "depth")
    paths = prefixes(once.withColumnRenamed("conv_id", "rep"), ["turns", "total", "weight"])

    inner = paths.where(F.col("depth") < F.col("turns")).select("node").distinct()
    leaves = sequences.join(inner, "node", "left_anti").select("rep", F.lit(True).alias("leaf"))
    long_ones = long_ones.withColumnRenamed("conv_id", "rep")
    told = sequences.select("rep").join(leaves, "rep", "left").select("rep", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    paths = saved(spread_join(paths, told, "rep", long_ones, "depth"))

    after = F.col("total") - F.col("upto") + F.col("bytes")
    nodes = saved(
        paths.groupBy("node", "parent", "depth", "upto", "bytes").agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * after).alias("gross"),
            F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner"),
        )
    )
    # Each node belongs to the smallest leaf below it; what a leaf owns is the end of its path.
    owned = nodes.groupBy(F.col("owner").alias("rep")).agg(F.min(F.struct("depth", (F.col("upto") - F.col("bytes")).alias("skipped"))).alias("own"))
    each = spread_join(paths.where("leaf"), owned.select("rep", F.col("own.depth").alias("own_from"), "own.skipped"), "rep", long_ones, "depth")
    held = F.when(F.col("depth") >= F.col("own_from"), after).otherwise(F.col("total") - F.col("skipped"))
    child = (F.col("depth") + 1 >= F.col("own_from")) & (F.col("depth") < F.col("turns"))
    below = each.groupBy("node").agg(F.sum(held).alias("distinct_bytes"), F.sum(child.cast("long")).alias("n_children"))

    whole = nodes.join(below, "node").join(end_lists(wholes.select("node", "conv_id")), "node", "left")
    whole = saved(
        whole.select(
            "node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", (F.col("gross") - F.col("distinct_bytes")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
    names = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    crowded = hot_keys(whole.withColumnRenamed("node", "_own").select(F.col("_own").alias("parent"), "n_children"), "parent", "n_children")
    below_root = spread_join(whole.where("parent IS NOT NULL"), names, "parent", crowded, "node")
    root = whole.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return below_root.unionByName(root).select(*columns, "node", "parent")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: crc32 is worked out bit by bit: the polynomial is a fixed value.
OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CAST(3988292384 AS BIGINT) * (r & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS side, place, role, text FROM c JOIN t ON t.conv_id = base AND place <= h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place > h),
s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY side, place) FILTER (role IS NOT NULL) AS path FROM (SELECT * FROM c LEFT JOIN r USING (conv_id)) GROUP BY conv_id),
p AS (SELECT conv_id, len(path) AS turns, coalesce(path, []) AS path, unnest(range(0, coalesce(len(path), 0) + 1)) AS depth FROM s),
n AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (coalesce(turns, 0) = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
k AS (SELECT n.*, n.node[1:n.depth - 1] AS parent, CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.node[n.depth].text) END AS bytes,
    (SELECT count(*) FROM n AS m WHERE m.depth = n.depth + 1 AND m.node[1:m.depth - 1] = n.node) AS n_children FROM n),
u AS (SELECT node, depth, unnest(range(0, depth + 1)) AS above, n_children, (n_convs - 1) * bytes AS saved FROM k),
a AS (SELECT node[1:above] AS node, above AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1, 2)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a ON a.depth = k.depth AND a.node = k.node LEFT JOIN n AS q ON q.depth = k.depth - 1 AND q.node = k.parent
"""
