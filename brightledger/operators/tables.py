"""Relational building blocks: conflict-aware aggregates, ordered windows, exact joins, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import same_number


def distinct_or_conflict(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one distinct value of each key, or null with a conflict: a candidate is never chosen."""
    return df.groupBy(*keys).agg(
        F.when(F.countDistinct(value) == 1, F.min(value)).alias("value"), (F.countDistinct(value) > 1).alias("conflict"), F.count(value).alias("candidates")
    )


def unique_or_null(value: str) -> Column:
    return F.when(F.countDistinct(value) == 1, F.min(value))


def cell_state(df: DataFrame, keys: list[str]) -> DataFrame:
    """State of a cell from its candidates (status, value): empty, rejected, unverified, conflict, pending or value.

    States are tried in that order; confirmed tells whether people confirmed all.
    """
    rejected = F.col("status") == "human_rejected"
    able = F.col("status").isin("source_verified", "human_confirmed")
    live = ~rejected
    parts = df.groupBy(*keys).agg(
        F.count_if(F.col("status").isNotNull()).alias("n"), F.count_if(live).alias("live"), F.count_if(live & (~able | F.col("value").isNull())).alias("unverified"),
        F.countDistinct(F.when(live & able, F.col("value"))).alias("values"), F.min(F.when(live & able, F.col("value"))).alias("least"),
        F.coalesce(F.bool_and(F.when(live, F.col("status") == "human_confirmed")), F.lit(False)).alias("confirmed"),
    )
    state = (
        F.when(F.col("n") == 0, "empty").when(F.col("live") == 0, "rejected").when(F.col("unverified") > 0, "unverified")
        .when(F.col("values") > 1, "conflict").when(~F.col("confirmed"), "pending").otherwise("value")
    )
    return parts.withColumn("state", state).select(*keys, "state", F.when(F.col("state").isin("pending", "value"), F.col("least")).alias("value"), "confirmed")


def two_phase_sum(df: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """Sums inside each source, then the one distinct sum across sources or a conflict."""
    return distinct_or_conflict(df.groupBy(*keys, source).agg(F.sum(value).alias("_sum")), keys, "_sum")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """The last value that wasn't null, up to the row."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def begins_run(keys: list[str], order: list[str], value: str) -> Column:
    """1 where a row differs from its neighbour before, or has none, else 0."""
    by = W.partitionBy(*keys).orderBy(*order)
    return F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & (F.row_number().over(by) > 1), 0).otherwise(1)


def run_groups(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Consecutive equal rows of each key: its first and last order value and size."""
    first = order[0]
    marked = df.withColumn("_new", begins_run(keys, order, value))
    marked = marked.withColumn("run", F.sum("_new").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run", value).agg(F.min(first).alias("first"), F.max(first).alias("last"), F.count(F.lit(1)).alias("n"))


def occurrence_join(left: DataFrame, right: DataFrame, label: list[str], left_order: list[str], right_order: list[str], how: str = "full") -> DataFrame:
    """Join the n-th occurrence of a label on one side with the n-th on the other."""
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(W.partitionBy(*label).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*label, "occurrence"], how)


def admitted(requests: DataFrame, key: list[str], ts: str, seconds: int, most: int, order: str) -> DataFrame:
    """Requests with place (among those of their key in the ``seconds`` before, itself included), admitted where that is at most ``most``, and wait.

    wait: seconds until the oldest request of a full window leaves it; 0 for one that is
    admitted. Requests of the same time are told apart by ``order``.
    """
    at = F.unix_micros(ts)
    numbered = requests.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(at, order)))
    earlier = F.count(F.lit(1)).over(W.partitionBy(*key).orderBy(at).rangeBetween(W.unboundedPreceding, -seconds * 1_000_000))
    placed = numbered.withColumn("place", F.col("_n") - earlier)
    back = F.lag(at, most).over(W.partitionBy(*key).orderBy(at, order))
    wait = F.when(F.col("place") > most, F.ceil((back + seconds * 1_000_000 - at) / 1_000_000)).otherwise(0)
    return placed.withColumn("admitted", F.col("place") <= most).withColumn("wait", F.greatest(wait, F.lit(0))).drop("_n")


def rolling_count(key: list[str], ts: str, seconds: int) -> Column:
    """Rows of the key in the ``seconds`` up to and including the row's time."""
    by = W.partitionBy(*key).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return F.count(F.lit(1)).over(by)


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two sources cell by cell: both_blank, extra, missing, equal or different."""
    both = expected.select(*keys, F.col("value").alias("expected")).join(actual.select(*keys, F.col("value").alias("actual")), keys, "full")
    outcome = (
        F.when(F.col("expected").isNull() & F.col("actual").isNull(), "both_blank").when(F.col("expected").isNull(), "extra")
        .when(F.col("actual").isNull(), "missing").when(F.col("expected") == F.col("actual"), "equal").otherwise("different")
    )
    return both.withColumn("outcome", outcome)


def unique_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with the right row of their key, where there is exactly one; without it otherwise."""
    single = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"), *[F.min(c).alias(c) for c in right.columns if c not in keys])
    found = left.join(single, keys, "left")
    return found.select(*left.columns, *[F.when(F.col("matches") == 1, F.col(c)).alias(c) for c in right.columns if c not in keys], F.coalesce("matches", F.lit(0)).alias("matches"))


def contained(points: DataFrame, spans: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of a point interval [start, end] and a span [l, r] of its key that holds it whole.

    Both are dealt to buckets of ``width``; a span goes to every bucket that it
    touches, a point to its start's, so that each pair meets once and the join is
    on equal keys.
    """
    low, high = F.floor(F.col("l") / width), F.floor(F.col("r") / width)
    dealt = spans.withColumn("_b", F.explode(F.sequence(low, high)))
    return points.withColumn("_b", F.floor(F.col("start") / width)).join(dealt, [*key, "_b"]).where("l <= start AND end <= r").drop("_b")


def digest_of_group(df: DataFrame, keys: list[str], part: Column, item: Column) -> DataFrame:
    """sha256 of ``part:item`` lines of each key, in order of part."""
    listed = F.array_sort(F.collect_list(F.struct(part.alias("k"), item.alias("v"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x["k"], F.lit(":"), x["v"])), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


#: What a scored cell says, beside its value, and which of it an accuracy is about.
SCORED = ["company_id", "statement_type", "concept", "period", "scope", "currency", "unit_scale"]
ACCURACIES = {"period_accuracy": ["period"], "scope_accuracy": ["scope"], "unit_accuracy": ["currency", "unit_scale"]}


#: Rows that one task sorts or hashes at most, on average.
ROWS_OF_A_PART = 250_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Into how many parts rows are dealt so that a task's memory doesn't grow with them, whatever the session's number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, rows // ROWS_OF_A_PART + 1)


def score(expected: DataFrame, actual: DataFrame, anchor: list[str], tables: list[str], rows: int | None = None) -> DataFrame:
    """Seven scores of extracted cells, matched by their source anchors alone.

    Both sides have the columns anchor, SCORED and value; ``actual`` has a
    verification_state as well. ``tables``: the part of the anchor that names a table.
    Returns metric, numerator, denominator, value (null for no denominator), and of
    accuracies coverage_numerator and coverage_denominator. Accuracies are shares of
    all expected cells, covered or not; a verified cell that nobody expected is falsely
    verified. Anchors that are null match each other; one that repeats is an error.
    ``rows``: about how many rows both sides have; they are counted if it isn't given.
    """
    number = parts_for(expected.sparkSession, expected.count() + actual.count() if rows is None else rows)
    fields = [*SCORED, "value"]
    at = F.struct(*anchor).alias("at")  # as a struct, nulls are equal
    e = expected.select(at, *(F.col(c).alias(f"e_{c}") for c in fields), F.lit(True).alias("wanted")).repartition(number, "at")
    a = actual.select(at, *(F.col(c).alias(f"a_{c}") for c in fields), F.col("verification_state").alias("state"), F.lit(True).alias("found")).repartition(number, "at")
    for side, name in ((e, "expected"), (a, "actual")):
        if not duplicates(side, ["at"]).isEmpty():
            raise ValueError(f"duplicate {name} anchor")
    both = e.join(a, "at", "full")
    wanted, found = F.coalesce("wanted", F.lit(False)), F.coalesce("found", F.lit(False))
    same = lambda c: F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}"))
    every = lambda parts: reduce(lambda x, y: x & y, parts)
    told = lambda cs: wanted & found & every([F.col(f"a_{c}").isNotNull() for c in cs])
    equal = same_number(F.col("e_value"), F.col("a_value"))
    verified = found & (F.coalesce(F.col("state") == "VERIFIED", F.lit(False)))
    count = lambda c, name: F.count_if(c).alias(name)
    numeric, concept = wanted & F.col("e_value").isNotNull(), wanted & F.col("e_concept").isNotNull()
    parts = [
        count(wanted, "n"), count(concept, "concepts"), count(concept & found & same("concept"), "recalled"), count(numeric, "numbers"), count(numeric & found & F.col("a_value").isNotNull(), "numbers_covered"),
        count(numeric & found & equal & every([same(c) for c in ("period", "scope", "currency", "unit_scale")]), "numbers_right"), count(verified, "verified"),
        count(verified & ~(wanted & equal & every([same(c) for c in SCORED])), "falsely"),
    ]
    for name, cs in ACCURACIES.items():
        parts += [count(told(cs), f"{name}_covered"), count(told(cs) & every([same(c) for c in cs]), f"{name}_right")]
    sides = expected.select(*tables, "statement_type", F.lit(1).alias("in")).unionByName(actual.select(*tables, "statement_type", F.lit(2).alias("in"))).repartition(number, *tables)
    discovered = sides.groupBy(*tables, "statement_type").agg(F.bit_or("in").alias("in"))
    discovered = discovered.agg(count(F.col("in") == 3, "tables_found"), count(F.col("in") != 2, "tables"))
    row = lambda metric, top, low, covered=None: F.struct(F.lit(metric).alias("metric"), F.col(top).alias("numerator"), F.col(low).alias("denominator"), (F.col(covered) if covered else F.lit(None).cast("long")).alias("coverage_numerator"), (F.col(low) if covered else F.lit(None).cast("long")).alias("coverage_denominator"))
    rows = [row("main_table_discovery", "tables_found", "tables"), *(row(m, f"{m}_right", "n", f"{m}_covered") for m in ACCURACIES), row("core_concept_recall", "recalled", "concepts"), row("numeric_accuracy", "numbers_right", "numbers", "numbers_covered"), row("false_verified_rate", "falsely", "verified")]
    counts = both.agg(*parts).crossJoin(F.broadcast(discovered))  # one row beside one row
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*", F.try_divide(F.col("r.numerator").cast("double"), F.col("r.denominator").cast("double")).alias("value"))


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """Faults of a manifest of files (document_id, company_id, split, sha256, origin, category): fault and subject, a row for each.

    Every field is required; split is dev or holdout, origin real or synthetic, sha256
    lower-case hex; documents and contents are unique, and a company is in one split only.
    """
    named = F.coalesce("document_id", F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    own = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"missing:{c}")) for c in ("document_id", "company_id", "split", "sha256", "origin", "category")], F.when(~blank("split") & ~F.col("split").isin("dev", "holdout"), F.lit("invalid:split")),
        F.when(~blank("origin") & ~F.col("origin").isin("real", "synthetic"), F.lit("invalid:origin")), F.when(~blank("sha256") & ~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit("invalid:sha256")),
    ))
    of_rows = manifest.select(F.explode(own).alias("fault"), named.alias("subject"))
    again = lambda c: duplicates(manifest, [c]).select(F.lit(f"duplicate:{c}").alias("fault"), F.coalesce(c, F.lit("")).alias("subject"))
    leaked = split_leakage(manifest).select(F.lit("leaked").alias("fault"), F.col("company_id").alias("subject"))
    return of_rows.unionByName(again("document_id")).unionByName(again("sha256")).unionByName(leaked)


def split_leakage(manifest: DataFrame) -> DataFrame:
    """Companies whose documents are in more than one split (company_id, split)."""
    return manifest.groupBy("company_id").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("files")).where("splits > 1")
