"""Views of statements and modules: states, review filters, orders, roll-ups, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_folded
from .tables import cell_state

# Selection -----------------------------------------------------------------------


def readable_batch(imports: DataFrame, key: str, code: Column, bound: Column, *ties: Column) -> DataFrame:
    """The import that each key reads: of those completed or partial for the bound company, completed before partial, then the latest.

    ``imports`` has state, completed_at and the columns of ``key``, code, bound and ties.
    """
    able = imports.where(F.col("state").isin("completed", "partial") & (code == bound))
    by = W.partitionBy(key).orderBy((F.col("state") == "completed").desc(), F.col("completed_at").desc(), *ties)
    return able.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def without_supplements(items: DataFrame, statement: list[str], supplemental: str = "supplemental") -> DataFrame:
    """Items that aren't supplements; statements of supplements alone vanish with them. A null flag is no supplement."""
    return items.where(~F.coalesce(F.col(supplemental), F.lit(False))).select(*[c for c in items.columns if c != supplemental])


def label_search(cells: DataFrame, rows: list[str], label: str, source_name: str, query: str) -> DataFrame:
    """All cells of the rows whose label, or the source name of any candidate of which, holds the query. An empty query keeps all."""
    if not query:
        return cells
    hit = F.coalesce(F.col(label).contains(query), F.lit(False)) | F.coalesce(F.col(source_name).contains(query), F.lit(False))
    return cells.join(cells.where(hit).select(*rows).distinct(), rows, "left_semi")


def note_search(notes: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Notes whose text holds the query, whatever the case."""
    return notes.where(contains_folded(F.col(text), query))


def reviewed_cells(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """State of each cell (see ``cell_state``), and whether it needs review: unless people decided on all its candidates, or its sources disagree."""
    undecided = candidates.groupBy(*keys).agg(F.bool_or(~F.coalesce(F.col("status").isin("human_confirmed", "human_rejected"), F.lit(False))).alias("undecided"))
    states = cell_state(candidates, keys).join(undecided, keys)
    return states.withColumn("needs_review", F.col("state").isin("pending", "unverified", "conflict") | F.col("undecided")).drop("undecided")


REVIEWS = ["all", "conflict", "confirmed", "unreviewed"]


def review_filter(cells: DataFrame, rows: list[str], review: str) -> DataFrame:
    """Cells of the rows with a cell in the wanted state of review."""
    if review not in REVIEWS:
        raise ValueError(f"review must be one of {REVIEWS}")
    wanted = {"all": F.lit(True), "conflict": F.col("state") == "conflict", "confirmed": (F.col("state") == "value") & F.col("confirmed"), "unreviewed": F.col("needs_review")}[review]
    return cells.join(cells.where(wanted).select(*rows).distinct(), rows, "left_semi")


def review_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key how many cells are in conflict, confirmed and to be reviewed."""
    return cells.groupBy(*keys).agg(
        F.count_if(F.col("state") == "conflict").alias("conflict"), F.count_if((F.col("state") == "value") & F.col("confirmed")).alias("confirmed"), F.count_if("needs_review").alias("unreviewed")
    )


def dashboard(projects: DataFrame, key: str) -> DataFrame:
    """Of each key: projects with stale metrics, with a current section, and whose last export still has its section's input hash."""
    return projects.groupBy(key).agg(
        F.count(F.lit(1)).alias("projects"), F.count_if("metrics_stale").alias("stale"), F.count_if(F.col("section_state") == "current").alias("current"),
        F.count_if(F.col("export_hash") == F.col("section_hash")).alias("exports_current"),
    )


# Orders --------------------------------------------------------------------------


def source_order(items: DataFrame, concept: str, newest: list[Column], standard: Column) -> DataFrame:
    """Rows in the order of the newest statement that shows them, those that none shows behind in standard order.

    ``items`` has concept, source_order (null where it couldn't be located) and what
    ``newest`` (the statements' order) and ``standard`` are made of. Returns concept,
    statement_rank and place (null without a located source) and fallback.
    """
    first = F.struct(F.struct(*newest).alias("statement"), F.col("source_order").alias("at"))
    return items.groupBy(concept).agg(F.min(F.when(F.col("source_order").isNotNull(), first)).alias("f"), F.min(standard).alias("fallback")).select(
        concept, F.col("f.statement").alias("statement_rank"), F.col("f.at").alias("place"), F.coalesce("fallback", F.lit(2**31 - 1)).alias("fallback")
    )


def listed_order(label: Column, labels: list[str]) -> Column:
    """Place of a label in a fixed list, from 1; those that it doesn't name come behind."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0).cast("long")), F.lit(len(labels) + 1).cast("long"))


def queue_pick(tasks: DataFrame, *ties: Column, n: int = 1) -> DataFrame:
    """The next tasks of a queue: queued ones, those in front before background ones, then the oldest."""
    return tasks.where("state = 'queued'").orderBy(F.coalesce("background", F.lit(False)), "created_at", *ties).limit(n)


# Roll-ups ------------------------------------------------------------------------


def coverage_rollup(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a document's tables added up; partial where a table isn't complete or a cell in conflict or unmapped."""
    counters = ["tables_found", "tables_parsed", "numeric_cells", "extracted_cells", "blank_cells", "unreadable_cells"]
    partial = F.bool_or((F.col("status") != "complete") | (F.coalesce("conflicts", F.lit(0)) > 0) | (F.coalesce("unmapped", F.lit(0)) > 0))
    return tables.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], F.when(partial, "partial").otherwise("complete").alias("status"))


def import_rollup(modules: DataFrame, keys: list[str]) -> DataFrame:
    """State and quality of an import from its modules (module_key, state, has_gaps, warned, sha256).

    state: failed where nothing succeeded, partial where something failed, else
    completed. quality: failed, passed_with_gaps, warning or passed, the first that
    applies. digest: sha256 of ``key:hash`` of the modules that succeeded, in order of key.
    """
    done, failed = F.count_if(F.col("state") == "succeeded"), F.count_if(F.col("state") == "failed")
    state = F.when(done == 0, "failed").when(failed > 0, "partial").otherwise("completed")
    quality = F.when(done == 0, "failed").when((failed > 0) | F.bool_or("has_gaps"), "passed_with_gaps").when(F.bool_or("warned"), "warning").otherwise("passed")
    hashes = F.array_sort(F.collect_list(F.when(F.col("state") == "succeeded", F.concat_ws(":", "module_key", "sha256"))))  # a module is one of 40
    return modules.groupBy(*keys).agg(done.alias("done"), failed.alias("failed"), state.alias("state"), quality.alias("quality"), F.sha2(F.array_join(hashes, ""), 256).alias("digest"))


def coverage_by_category(modules: DataFrame, keys: list[str]) -> DataFrame:
    """Modules that have data and that there are, without those that the source doesn't offer."""
    offered = ~F.coalesce("unavailable", F.lit(False))
    return modules.groupBy(*keys).agg(F.count_if(offered & (F.col("state") == "succeeded")).alias("covered"), F.count_if(offered).alias("offered"))


#: Labels of what a set of statements needs looking at. Fixed values.
REVIEW_SOURCE, UNBALANCED, UNDISCLOSED = "来源待核对", "勾稽不一致", "缺少披露项，未检查"


def diagnostic_summary(statements: DataFrame, keys: list[str], title: Column) -> DataFrame:
    """Labels of what is to be looked at in the statements of each key (source_status, check_statuses), in a fixed order."""
    any_check = lambda s: F.bool_or(F.array_contains("check_statuses", s))
    labels = F.array_compact(F.array(
        F.when(F.bool_or(F.col("source_status") == "needs_review"), F.lit(REVIEW_SOURCE)), F.when(any_check("conflict"), F.concat(F.min(title), F.lit(UNBALANCED))),
        F.when(any_check("not_checked_missing_disclosure"), F.lit(UNDISCLOSED)),
    ))
    return statements.groupBy(*keys).agg(labels.alias("labels"))


def formula_status(statuses: Column) -> Column:
    """Of a statement's checks: warning for any conflict, passed where all passed, else not_checked."""
    return F.when(F.array_contains(statuses, "conflict"), "warning").when((F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "passed"), "passed").otherwise("not_checked")


def acceptance_summary(modules: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Of each company: modules with data and without, periods seen, and how its checks ended."""
    of_modules = modules.groupBy(key).agg(F.count_if("has_data").alias("with_data"), F.count_if(~F.col("has_data")).alias("without_data"), F.sum("periods").alias("periods"))
    of_checks = checks.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "conflict")], F.count_if(F.col("status").startswith("not_checked")).alias("not_checked"), F.countDistinct("status").alias("statuses"))
    return of_modules.join(of_checks, key, "left")


def with_diagnostics(items: DataFrame, diagnostics: DataFrame, key: str, absent: dict[str, Column]) -> DataFrame:
    """Items with the diagnostics of their statement, or the values for one that has none."""
    found = items.join(diagnostics, key, "left")
    return found.select(*items.columns, *[F.coalesce(c, absent[c]).alias(c) if c in absent else F.col(c) for c in diagnostics.columns if c != key])


# Records and rows ----------------------------------------------------------------


def hydrated(rows: DataFrame, source: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Rows with the values of their source row where they have none of their own."""
    return rows.join(source.select(*keys, F.col(values).alias("_own")), keys, "left").withColumn(values, F.coalesce(values, "_own")).drop("_own")


def aged_rows(rows: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Every age row thrice: itself, its balance again, and an allowance that isn't disclosed by age."""
    own = F.struct(F.lit(0).alias("part"), F.col(key).alias("key"), F.col(label).alias("label"), F.col(value).alias("value"))
    balance = F.struct(F.lit(1).alias("part"), F.concat(F.col(key), F.lit("|balance")).alias("key"), F.lit("期末余额").alias("label"), F.col(value).alias("value"))
    allowance = F.struct(F.lit(2).alias("part"), F.concat(F.col(key), F.lit("|allowance")).alias("key"), F.lit("坏账准备").alias("label"), F.lit(None).alias("value"))
    rest = [c for c in rows.columns if c not in (key, label, value)]
    return rows.select(*rest, F.explode(F.array(own, balance, allowance)).alias("r")).select(*rest, "r.*")


def active_rows(rows: DataFrame, keys: list[str], key: Column, blank: Column) -> DataFrame:
    """Rows with a value, and the blank ones whose key ends like that of one with a value (the same segment of another measure)."""
    tailed = rows.withColumn("_tail", F.regexp_extract(key, "_([^_]+)$", 1))
    active = tailed.where(~blank).select(*keys, "_tail").distinct()
    return tailed.join(active, [*keys, "_tail"], "left_semi").drop("_tail")


def module_groups(modules: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Modules under their parent in the menu; one without a parent is a group of its own. Children in their order; a menu is small."""
    nested = F.coalesce(F.col("menu_parent"), F.lit("")) != ""
    own = F.when(nested, F.lit("")).otherwise(F.col("module_key"))
    name = F.when(nested, F.col("menu_parent")).otherwise(F.coalesce(F.nullif("module_name", F.lit("")), F.col("module_key")))
    return modules.groupBy(*keys, name.alias("name"), nested.alias("nested"), own.alias("_own")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "module_key"))), lambda x: x["module_key"]).alias("children")
    ).drop("_own")


def aligned(left: Column, right: Column) -> Column:
    """Two arrays zipped by position, only where they are equally long; null otherwise."""
    return F.when(F.size(left) == F.size(right), F.arrays_zip(left.alias("left"), right.alias("right")))


def cell_unit(unit: Column, data_type: Column, money: list[str]) -> Column:
    """Unit of a cell: a column of growth or composition is in percent, whatever money unit its row has."""
    share = F.coalesce(data_type.rlike("[%％]") | data_type.isin("同比", "占收入比"), F.lit(False))
    return F.when(unit.isin(money) & share, "%").otherwise(unit)


def axis_bounds(values: DataFrame, keys: list[str], value: str, money: Column, power: Column, zero: bool) -> DataFrame:
    """Scale of a chart's axis for the finite values of each key: magnitude (power of ten), least, most and the interval of five steps.

    ``money``: whether values are in a money unit, ``power``: its power of ten; other
    units aren't scaled. With ``zero`` the axis holds 0, as it does without values.
    """
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    own = values.groupBy(*keys).agg(F.max(F.abs(finite) * F.pow(F.lit(10.0), power)).alias("_l"), F.min(finite).alias("_a"), F.max(finite).alias("_b"), F.bool_and(money).alias("_m"), F.max(power).alias("_p"))
    size = F.when(F.col("_m"), F.when(F.col("_l") >= 1e12, 12).when(F.col("_l") >= 1e9, 9).when(F.col("_l") >= 1e6, 6).when(F.col("_l") >= 1e3, 3).otherwise(0)).otherwise(0)
    scaled = lambda c: F.col(c) * F.pow(F.lit(10.0), F.when(F.col("_m"), F.col("_p")).otherwise(0) - F.col("magnitude"))
    low, high = (F.coalesce(f(scaled(c), F.lit(0.0)) if zero else scaled(c), F.lit(0.0)) for f, c in ((F.least, "_a"), (F.greatest, "_b")))
    out = own.withColumn("magnitude", size).select(*keys, "magnitude", F.floor(low).alias("least"), F.ceil(high).alias("most"))
    out = out.withColumn("most", F.when(F.col("most") == F.col("least"), F.col("least") + 1).otherwise(F.col("most")))
    return out.withColumn("interval", (F.col("most") - F.col("least")) / 5)


# Matrices ------------------------------------------------------------------------


def statement_matrix(candidates: DataFrame, catalogue: DataFrame, group: list[str]) -> DataFrame:
    """Cells of a statement's matrix: every row of the catalogue and every other disclosed one, by every period of its group.

    ``candidates``: group, concept, label, period_end, source_order, status, value and
    supplemental. ``catalogue`` (small): concept, label, section, place. Supplements
    are left out. Rows follow the order of the newest period that shows them, then the
    catalogue's, then their label. Returns group, concept, label, section, period_end, row_place, state, value, confirmed and
    needs_review; a cell without candidates is empty.
    """
    own = without_supplements(candidates, group)
    periods = own.select(*group, "period_end").distinct()
    known = catalogue.select("concept", F.col("label").alias("_l"), "section", F.col("place").alias("_place"))
    shown = own.groupBy(*group, "concept").agg(F.min("label").alias("label"), F.min(F.when(F.col("source_order").isNotNull(), F.struct((-F.datediff("period_end", F.lit("1970-01-01").cast("date"))).alias("age"), "source_order"))).alias("_at"))
    listed = [r["concept"] for r in catalogue.select("concept").distinct().collect()]  # a fixed list
    every = periods.select(*group).distinct().withColumn("concept", F.explode(F.array(*map(F.lit, listed)))).unionByName(own.select(*group, "concept")).distinct()
    rows = every.join(shown, [*group, "concept"], "left").join(F.broadcast(known), "concept", "left")
    label, section = F.coalesce("_l", "label"), F.coalesce("section", F.lit("其他披露科目"))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.col("_at.age").asc_nulls_last(), F.col("_at.source_order").asc_nulls_last(), F.col("_place").asc_nulls_last(), label, "concept"))
    rows = rows.select(*group, "concept", label.alias("label"), section.alias("section"), place.alias("row_place"))
    states = reviewed_cells(own.select(*group, "concept", "period_end", "status", "value"), [*group, "concept", "period_end"])
    cells = rows.join(periods, group).join(states, [*group, "concept", "period_end"], "left")
    return cells.withColumn("state", F.coalesce("state", F.lit("empty"))).withColumn("confirmed", F.coalesce("confirmed", F.lit(False))).withColumn("needs_review", F.coalesce("needs_review", F.lit(False)))


def snapshot_hash(projects: DataFrame, documents: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A digest of all that a project's results rest on: key and hash. It changes with a document, a fact, the revision or the formula.

    ``projects``: key, revision, formula; ``documents``: key, document_id, sha256;
    ``facts``: key, fact_id, concept, value. A project's own documents and facts are few.
    """
    listed = lambda df, name, *cols: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    both = projects.join(listed(documents, "documents", "document_id", "sha256"), key, "left").join(listed(facts, "facts", "fact_id", "concept", "value"), key, "left")
    return both.select(key, F.sha2(F.to_json(F.struct("documents", "facts", "formula", F.col(key).alias("project"), "revision"), {"ignoreNullFields": "false"}), 256).alias("hash"))
