"""Metrics over statement facts: one plan for the whole catalogue.

Facts are first reduced to one candidate row for each (group, table, period, kind,
concept). Every reporting column is multiplied by the catalogue's inputs, a list
of fixed length, whose target periods are joined to the candidates by equality.
Inputs of one metric meet again in an array of at most 11 entries, on which guards
and formulas are plain expressions. So the facts are shuffled once, however many
metrics there are, and no input is looked up by a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import DECIMAL
from ..functions.periods import bound, day_before, days_30_360, quarter_end_before, year_before
from .metric_catalogue import BS, CATALOGUE, CATEGORIES, VERSION, Metric

GROUP = ["entity", "scope", "currency", "document_key"]
#: Reasons for which a metric is unavailable. Fixed values.
NO_SPAN, NO_START, NO_DATE = "缺少该期间的累计报表", "缺少明确的期间起点", "期间或数值无效"
UNCLEAR, UNVERIFIED, UNITS, CONFLICT = "主体、范围、期间或单位口径待确认", "来源数值尚未通过校验", "输入单位不一致", "同一科目存在冲突，请先核对候选"
NOT_WHOLE = "不足整月，30/360口径不适用"
ZERO, NEGATIVE = "分母为零", "分母为负，不适用常规比率解释"


def grouped(facts: DataFrame) -> DataFrame:
    """Facts with the key of their group: a document of its own where the scope is unknown."""
    return facts.withColumn("document_key", F.when(F.col("scope") == "unknown", F.coalesce("document_id", F.lit(""))).otherwise(""))


def unit_class(unit: Column) -> Column:
    return F.when(unit.isin("元/股", "股", "%"), unit).otherwise("元")


def candidates(facts: DataFrame) -> DataFrame:
    """One row for each (group, table, period, kind, concept): what its candidates agree on, and their lineage."""
    clean = (F.size(F.coalesce("issues", F.array())) == 0) & (F.col("statement_state") == "extracted") & F.col("period_kind").isNotNull() & F.coalesce(F.col("unit_known"), F.lit(True))
    verified = F.col("status").isin("source_verified", "human_confirmed") & F.col("value").isNotNull()
    lineage = F.struct("item_id", "document_id", F.col("source_name").alias("label"), F.col("value").alias("value"), unit_class(F.col("raw_unit")).alias("unit"), "status")
    return (
        grouped(facts).where(~F.col("status").eqNullSafe("human_rejected"))
        .withColumn("kind", F.when(F.col("statement_type") == BS, F.lit("")).otherwise(F.coalesce("period_kind", F.lit(""))))
        .withColumn("start", F.when(F.col("statement_type") == BS, F.lit(None).cast("date")).otherwise(F.col("period_start")))
        .groupBy(*GROUP, "statement_type", "start", F.col("period_end").alias("end"), "kind", "concept")
        .agg(
            F.countDistinct("value").alias("values"), F.min("value").alias("value"), F.bool_and(F.coalesce(clean, F.lit(False))).alias("clean"),
            F.bool_and(F.coalesce(verified, F.lit(False))).alias("verified"), F.min(unit_class(F.col("raw_unit"))).alias("unit"),
            F.max(unit_class(F.col("raw_unit"))).alias("other_unit"), F.bool_and(F.col("status") == "human_confirmed").alias("confirmed"),
            F.array_sort(F.collect_list(lineage)).alias("lineage"),
        )
    )


def reporting_columns(facts: DataFrame) -> DataFrame:
    """The periods of each group: its flow periods, and the balance dates that none of these ends on."""
    own = grouped(facts)
    flows = own.where((F.col("statement_type") != BS) & F.col("period_start").isNotNull()).select(*GROUP, F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("period_kind").alias("kind")).distinct()
    instants = own.where((F.col("statement_type") == BS) & F.col("period_end").isNotNull()).select(*GROUP, F.lit(None).cast("date").alias("start"), F.col("period_end").alias("end"), F.lit("instant").alias("kind")).distinct()
    return flows.unionByName(instants.join(flows.select(*GROUP, "end"), [*GROUP, "end"], "left_anti"))


def catalogue_inputs(metrics: list[Metric]) -> Column:
    """The inputs of all metrics as an array of structs, a constant."""
    rows = [F.struct(F.lit(i).alias("m"), F.lit(k).alias("k"), F.lit(x.concept).alias("concept"), F.lit(x.table).alias("table"), F.lit(x.offset).alias("offset"), F.lit(x.unit).alias("wanted"), F.lit(x.label).alias("concept_label")) for i, m in enumerate(metrics) for k, x in enumerate(m.inputs)]
    return F.array(*rows)


def looked_up(columns: DataFrame, found: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Every column with every metric's inputs: value, lineage, and the reason why an input can't be used."""
    flow = F.col("i.table") != BS
    offset, start, end = F.col("i.offset"), F.col("start"), F.col("end")
    target_end = F.when(offset == "opening", day_before(start)).when(offset == "previous", year_before(end)).when(offset == "previous_quarter", quarter_end_before(end)).otherwise(end)
    target_start = F.when(flow, F.when(offset == "previous", year_before(start)).otherwise(start))
    early = F.when(flow & start.isNull(), NO_SPAN).when((offset == "opening") & start.isNull(), NO_START).when(target_end.isNull() | (flow & target_start.isNull()), NO_DATE)
    asked = columns.withColumn("i", F.explode(catalogue_inputs(metrics))).select(
        *GROUP, "start", "end", "kind", "i.m", "i.k", "i.concept", "i.wanted", "i.concept_label", F.col("i.table").alias("statement_type"),
        target_start.alias("t_start"), target_end.alias("t_end"), F.when(flow, F.coalesce("kind", F.lit(""))).otherwise("").alias("t_kind"), early.alias("early"),
    )
    own = found.select(*(F.col(c).alias(f"c_{c}") for c in found.columns))
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in GROUP] + [F.col("statement_type") == F.col("c_statement_type"), F.col("concept") == F.col("c_concept"), F.col("t_end") == F.col("c_end"), F.col("t_start").eqNullSafe(F.col("c_start")), F.col("t_kind") == F.col("c_kind"), F.col("early").isNull()]
    joined = asked.join(own, same, "left")
    period = F.concat_ws("/", F.col("t_start").cast("string"), F.col("t_end").cast("string"))
    unclear = (F.col("scope") == "unknown") | F.coalesce(F.col("entity") == "", F.lit(True)) | F.coalesce(F.col("currency").isin("", "unknown"), F.lit(True)) | ~F.col("c_clean")
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("c_concept").isNull(), F.concat(F.lit("缺少输入："), F.col("concept_label"), F.lit("（"), period, F.lit("）")))
        .when(unclear, UNCLEAR).when(~F.col("c_verified"), UNVERIFIED)
        .when((F.col("c_unit") != F.col("wanted")) | (F.col("c_other_unit") != F.col("wanted")), UNITS)
        .when(F.col("c_values") != 1, CONFLICT)
    )
    return joined.select(*GROUP, "start", "end", "kind", "m", "k", reason.alias("reason"), F.when(reason.isNull(), F.col("c_value")).alias("value"), F.col("c_confirmed").alias("confirmed"), F.col("c_lineage").alias("lineage"))


def evaluated(metric: Metric) -> tuple[Column, Column]:
    """(value, reason) of one metric over the array ``args``; guards come in the order of its ratios."""
    names = {str(i): f"args[{i}]" for i in range(len(metric.inputs))}
    fill = lambda text: _fill(text, names)
    reasons, exact = [], not metric.ratios
    if metric.whole_months:
        reasons.append("WHEN days IS NULL THEN '" + NOT_WHOLE + "'")
    names["days"] = "CAST(days AS DOUBLE)"
    for i, (top, bottom) in enumerate(metric.ratios):
        low = fill(bottom)
        reasons += [f"WHEN {low} = 0 THEN '{ZERO}'", f"WHEN {low} < 0 THEN '{NEGATIVE}'"]
        names[f"r{i}"] = f"(CAST({fill(top)} AS DOUBLE) / nullif(CAST({low} AS DOUBLE), 0))"
    value = fill(metric.value)
    reason = F.expr(f"CASE {' '.join(reasons)} END") if reasons else F.lit(None).cast("string")
    return F.expr(value if exact else f"round({value}, 10)").cast("decimal(38,10)"), reason


def _fill(text: str, names: dict[str, str]) -> str:
    for name, used in names.items():
        text = text.replace("{" + name + "}", used)
    return text


def by_number(columns: list[Column], at_once: int = 12) -> Column:
    """The column with the number m. Found in two steps, so that few numbers are compared.

    All formulas together are too large for one generated method: they are evaluated
    inside a function of an array of one element, which needs none.
    """
    m, out = F.col("m"), None
    for start in range(0, len(columns), at_once):
        own = None
        for i, column in enumerate(columns[start : start + at_once], start):
            own = (F if own is None else own).when(m == i, column)
        out = (F if out is None else out).when(m < start + at_once, own)
    return bound(F.lit(0), lambda _: out)


def metric_cells(facts: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Every metric of every reporting column of every group.

    ``facts`` are rows of ``schemas.STATEMENT_FACT``. Returns the group, start, end,
    kind, code, label, category, unit, value, reason, status and inputs. A metric is
    unavailable for the first of its inputs, in their order, that can't be used;
    inputs up to and including that one are reported. A value is given exactly when
    there is no reason.
    """
    metrics = [m for m in CATALOGUE if codes is None or m.code in codes]
    cells = looked_up(reporting_columns(facts), candidates(facts), metrics)
    arrays = cells.groupBy(*GROUP, "start", "end", "kind", "m").agg(F.array_sort(F.collect_list(F.struct("k", "value", "reason", "confirmed", "lineage"))).alias("in"))
    first = F.try_element_at(F.filter("in", lambda x: x["reason"].isNotNull()), F.lit(1))
    until = F.coalesce(first["k"], F.lit(99))
    ready = arrays.select(
        *GROUP, "start", "end", "kind", "m", first["reason"].alias("missing"), F.transform("in", lambda x: x["value"]).alias("args"),
        days_30_360(F.col("start"), F.col("end")).alias("days"), F.filter("in", lambda x: x["k"] <= until).alias("used"),
    )
    outcomes = [evaluated(metric) for metric in metrics]
    values, guards = by_number([v for v, _ in outcomes]), by_number([g for _, g in outcomes])
    reason = F.coalesce(F.col("missing"), F.when(F.col("missing").isNull(), guards))
    done = ready.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), values))
    fact = lambda name: F.element_at(F.array(*[F.lit(getattr(m, name)) for m in metrics]), F.col("m") + 1)
    inputs = F.flatten(F.transform(F.filter("used", lambda x: x["lineage"].isNotNull()), lambda x: x["lineage"]))
    confirmed = (F.size(inputs) > 0) & F.forall("used", lambda x: F.coalesce(x["confirmed"], F.lit(False)))
    return done.select(
        *GROUP, "start", "end", "kind", fact("code").alias("code"), fact("label").alias("label"), fact("category").alias("category"), fact("unit").alias("unit"),
        F.lit(VERSION).alias("formula_version"), "value", "reason",
        F.when(F.col("value").isNull(), "unavailable").when(confirmed, "confirmed_inputs").otherwise("pending_review").alias("status"), inputs.alias("inputs"),
    )


def category_order(category: Column) -> Column:
    """Place of a category among those shown, from 1."""
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), category)


#: Ratios of the facts that users enter by hand: terms with their signs, the denominator last. Fixed values.
FACT_RATIOS = {
    "liabilities_to_assets": [("total_liabilities", 1), ("total_assets", 0)],
    "interest_bearing_debt_to_assets": [("interest_bearing_debt", 1), ("total_assets", 0)],
    "quick_ratio": [("current_assets", 1), ("inventory", -1), ("current_liabilities", 0)],
}


def fact_ratios(facts: DataFrame, key: str = "project") -> DataFrame:
    """The three looser ratios of hand-entered facts (entity, scope, period, currency, unit, concept, value) of each ``key``.

    Inputs are looked up in order: a missing one makes the ratio unavailable, a
    second candidate conflicted, even an equal one. Inputs must agree on entity,
    scope, period, currency and unit. A negative denominator is allowed; a zero one
    has a status of its own.
    """
    concepts = sorted({c for terms in FACT_RATIOS.values() for c, _ in terms})
    dims = F.concat_ws("|", "entity", "scope", F.col("period").cast("string"), "currency", "unit")
    own = lambda c, x: F.max(F.when(F.col("concept") == c, x))
    wide = facts.groupBy(key).agg(*[x for c in concepts for x in (F.count_if(F.col("concept") == c).alias(f"n_{c}"), own(c, F.col("value").cast(DECIMAL)).alias(f"v_{c}"), own(c, dims).alias(f"d_{c}"))])
    rows = []
    for code, terms in FACT_RATIOS.items():
        reason = None
        for c, _ in terms:
            missing = F.col(f"n_{c}") == 0
            reason = (F if reason is None else reason).when(missing, f"missing_required_input:{c}").when(F.col(f"n_{c}") > 1, "unresolved_fact_conflict")
        low = F.col(f"v_{terms[-1][0]}")
        same = F.array_size(F.array_distinct(F.array(*[F.col(f"d_{c}") for c, _ in terms]))) == 1
        reason = reason.when(~same, "entity_scope_period_unit_conflict").when(low == 0, "zero_denominator")
        top = F.lit(0)
        for c, sign in terms[:-1]:
            top = top + F.col(f"v_{c}") * sign
        status = F.when(reason.isNull(), "computed").when(reason.startswith("missing"), "unavailable").when(reason == "zero_denominator", reason).otherwise("conflicted")
        value = F.when(reason.isNull(), top.cast("double") / F.nullif(low.cast("double"), F.lit(0.0)))
        rows.append(F.struct(F.lit(code).alias("code"), value.alias("value"), status.alias("status"), reason.alias("reason")))
    return wide.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")
