"""Facts in versions, and the decisions of reviewers on items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPTED, STALE = "accepted", "fact_version_conflict"
#: Statuses of items, and the one that can't be confirmed. Fixed values.
CONFIRMED, REJECTED, NOT_FOUND = "human_confirmed", "human_rejected", "source_value_not_found"


def import_outcomes(batches: DataFrame) -> DataFrame:
    """What becomes of batches of facts (project, batch_id, arrived, expected_revision): outcome, and the project's revision after it.

    A project starts at revision 0. Its batches are taken in order of (arrived,
    batch_id); one is accepted when it expects the revision that the project then has,
    which it raises by one. Others, and such that expect null, are conflicts. Each
    project is one pass over its sorted rows, with a number as its state.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, revision = None, 0
        for rows in parts:
            outcomes, after = [], []
            for p, expected in zip(rows["project"], rows["expected_revision"], strict=True):
                if p != project:
                    project, revision = p, 0
                fits = expected == revision
                revision += fits
                outcomes.append(ACCEPTED if fits else STALE)
                after.append(revision)
            yield rows.assign(outcome=outcomes, revision=after)

    rows = batches.where("project IS NOT NULL").repartition("project").sortWithinPartitions("project", "arrived", "batch_id")
    types = {f.name: f.dataType.simpleString() for f in batches.schema}
    return rows.mapInPandas(each, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", outcome string, revision long")


def current_batches(outcomes: DataFrame) -> DataFrame:
    """project, revision, batch_id and conflicts: a project's facts are those of its last accepted batch alone; without any, batch_id is null."""
    return outcomes.groupBy("project").agg(
        F.max("revision").alias("revision"), F.max_by("batch_id", F.when(F.col("outcome") == ACCEPTED, F.col("revision"))).alias("batch_id"),
        F.count_if(F.col("outcome") == STALE).alias("conflicts"),
    )


def decided(items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest version of each item with the status that its reviewers gave it, and the outcome of every decision.

    ``items``: item_id, version, made_at, status and whatever else; a version made later
    replaces the one before and starts without decisions. ``decisions``: decision_id,
    item_id, at, decision (confirm or reject) and reason. A decision concerns the item's
    newest version at its time (of equal times, the largest version); without one its
    outcome is ``financial_item_not_found``. A confirmation of an item whose value isn't
    in its source is refused, ``source_value_not_found``, unless a rejection came before.
    Anything but a confirmation or rejection is an ``invalid_decision``. The last applied
    decision, by (at, decision_id), holds, with its reason. Per version only sums and
    extremes are kept, whatever number of decisions it has.
    """
    versions = items.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("made_at", "version"))).alias("made"))
    placed = decisions.select("decision_id", "item_id", "at", "decision", "reason").join(versions, "item_id", "left")
    before = F.filter("made", lambda v: v["made_at"] <= F.col("at"))
    placed = placed.withColumn("version", F.try_element_at(before, F.lit(-1))["version"]).drop("made")
    own = placed.join(items.select("item_id", "version", F.col("status").alias("_given")), ["item_id", "version"], "left")
    order = F.struct("at", "decision_id")
    rejected = own.where("decision = 'reject'").groupBy("item_id", "version").agg(F.min(order).alias("_first"))
    judged = own.join(rejected, ["item_id", "version"], "left")
    hidden = (F.col("_given") == NOT_FOUND) & F.coalesce(order < F.col("_first"), F.lit(True))
    outcome = (
        F.when(~F.coalesce(F.col("decision").isin("confirm", "reject"), F.lit(False)), "invalid_decision").when(F.col("version").isNull(), "financial_item_not_found")
        .when((F.col("decision") == "confirm") & hidden, NOT_FOUND).otherwise("applied")
    )
    judged = judged.select("decision_id", "item_id", "version", "at", "decision", "reason", outcome.alias("outcome"))
    last = judged.where("outcome = 'applied'").groupBy("item_id", "version").agg(F.max(F.struct("at", "decision_id", "decision", "reason")).alias("_last"), F.count(F.lit(1)).alias("decisions"))
    newest = versions.select("item_id", F.element_at("made", -1)["version"].alias("version"))
    now = items.join(newest, ["item_id", "version"]).join(last, ["item_id", "version"], "left")
    status = F.when(F.col("_last.decision") == "confirm", CONFIRMED).when(F.col("_last.decision") == "reject", REJECTED).otherwise(F.col("status"))
    now = now.select(*[c for c in items.columns if c != "status"], status.alias("status"), F.col("_last.reason").alias("decision_reason"), F.coalesce("decisions", F.lit(0)).alias("decisions"))
    return now, judged
