"""Merging and packing of what belongs to one document: fragments, overlapping groups, size budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged_fragments(fragments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One statement from the fragments (items, issues, start_line, end_line) of each key, in their order.

    Items follow one another, each issue stays once, lines span all fragments. Null
    arrays count as empty. Key columns may be null: nulls are one key.
    """
    listed = F.array_sort(F.collect_list(F.struct(order, F.coalesce("items", F.array()).alias("items"), F.coalesce("issues", F.array()).alias("issues"))))
    return fragments.groupBy(*keys).agg(
        F.flatten(F.transform(listed, lambda x: x["items"])).alias("items"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["issues"]))).alias("issues"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("fragments"),
    )


def merged_groups(groups: Column) -> Column:
    """Groups of a document's block ids, with those that share a member, directly or through others, made one.

    A fold over an array of arrays: every group takes in the merged ones that it
    overlaps. Members are sorted, and so are the groups. Null gives null.
    """
    empty = F.transform(F.slice(groups, F.lit(1), F.lit(0)), lambda g: g)
    apart = lambda done, g: F.filter(done, lambda x: ~F.arrays_overlap(x, g))
    joined = lambda done, g: F.array_sort(F.array_distinct(F.flatten(F.concat(F.filter(done, lambda x: F.arrays_overlap(x, g)), F.array(g)))))
    return F.array_sort(F.aggregate(groups, empty, lambda done, g: F.concat(apart(done, g), F.array(joined(done, g)))))


def batch_ends(sizes: Column, budget: int, repeated: Column | int = 0) -> Column:
    """Last position (from 1) of every batch when items are packed in order into batches of ``budget``.

    Each batch pays for the header rows that it repeats, of size ``repeated``. An item
    above what is left of the budget is a batch of its own. No items give no batches;
    null sizes count as 0.
    """
    again = (repeated if isinstance(repeated, Column) else F.lit(repeated)).cast("long")
    start = F.struct(again.alias("held"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(done: Column, size: Column) -> Column:
        own = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
        full = (done["held"] + own > budget) & (done["at"] > F.coalesce(F.try_element_at(done["ends"], F.lit(-1)), F.lit(0)))
        return F.struct(
            F.when(full, again + own).otherwise(done["held"] + own).alias("held"), (done["at"] + 1).alias("at"),
            F.when(full, F.concat(done["ends"], F.array(done["at"]))).otherwise(done["ends"]).alias("ends"),
        )

    return F.aggregate(sizes, start, step, lambda done: F.when(done["at"] > 0, F.concat(done["ends"], F.array(done["at"]))).otherwise(done["ends"]))


def packed_rows(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Parts of tables that fit a budget: keys, part (from 1), first_row, last_row, size and fits.

    ``rows``: keys, row (its number), size and header (a header row, repeated in every
    part). Row numbers stay those of the table. A part that doesn't fit holds one row
    that is too large. A table of header rows alone is one part.
    """
    body, heads = F.struct("row", "size"), F.coalesce(F.sum(F.when(F.col("header"), F.col("size"))), F.lit(0)).alias("heads")
    tables = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~F.col("header"), body))).alias("body"), heads, F.min("row").alias("least"), F.max("row").alias("most"))
    ends = batch_ends(F.transform("body", lambda r: r["size"]), budget, F.col("heads"))
    cut = tables.withColumn("ends", F.when(F.size("body") > 0, ends).otherwise(F.array(F.lit(0))))
    each = cut.select(*keys, "body", "heads", "least", "most", "ends", F.posexplode("ends").alias("at", "end"))
    start = F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(0)
    part = F.slice("body", start + 1, F.col("end") - start)
    held = F.col("heads") + F.aggregate(part, F.lit(0).cast("long"), lambda n, r: n + r["size"])
    return each.select(
        *keys, (F.col("at") + 1).alias("part"), F.coalesce(F.get(part, F.lit(0))["row"], "least").alias("first_row"), F.coalesce(F.try_element_at(part, F.lit(-1))["row"], "most").alias("last_row"), held.alias("size"), (held <= budget).alias("fits")
    )
