"""Connected components of a distributed edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, saved, spread_join

#: Rounds after which the search gives up; n nodes need about log(n) rounds.
MOST_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to its smallest one. The edges of a hub are dealt to several tasks."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
    return spread_join(both.where("b > a"), least.drop("n"), "a", hot_keys(least, "a"), "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them. Edges run from the larger to the smaller node."""
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
    moved = spread_join(edges, least.drop("n"), "a", hot_keys(least, "a"), "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges``.

    ``edges`` has two long columns, a and b, in either direction, with loops and
    repeats allowed; rows with a null end are ignored. Returns node, component for
    every node that some edge ties to another one. No edges give no rows. Each
    round is two joins of the edge list, saved in the shared folder; a star of any
    size is aggregated in parts, and its edges are joined in several tasks.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(ends)
    before = None
    for _ in range(MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = mark
        now = saved(small_star(saved(large_star(now))))
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")
