"""Read views and summaries of run logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators import compare
from assayer.operators.lineage import latest_per_key, reference_history, resolve_revisions, roots_and_leaves


def supervision(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """``section, name, detail, n``: run states, step states, runs that need attention, and the latest of each case.

    ``runs(attempt_id, case_id, line, status)``, ``steps(state)``.
    """
    empty = F.lit("").alias("detail")
    states = runs.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("run").alias("section"), "name", empty, "n")
    by_step = steps.groupBy(F.col("state").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("step").alias("section"), "name", empty, "n")
    attention = runs.filter("status <> 'evaluated'").select(F.lit("attention").alias("section"), F.col("attempt_id").cast("string").alias("name"), F.col("status").alias("detail"), F.lit(1).cast("long").alias("n"))
    latest = latest_per_key(runs.select("case_id", "line", "status"), ["case_id"], ["line"])
    latest = latest.select(F.lit("latest").alias("section"), F.col("case_id").cast("string").alias("name"), F.col("status").alias("detail"), F.col("line").cast("long").alias("n"))
    return states.unionByName(by_step).unionByName(attention).unionByName(latest)


def constellation_summary(runs: DataFrame) -> DataFrame:
    """One row: runs, cases, roots, leaves, deepest generation, distinct candidate states."""
    ends = roots_and_leaves(runs)
    return runs.join(ends, "attempt_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.countDistinct("case_id").alias("n_cases"), F.count_if("is_root").alias("n_roots"), F.count_if("is_leaf").alias("n_leaves"),
        F.max("generation").alias("max_generation"), F.countDistinct("state_sha256").alias("n_states"))


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 20) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, with the total and the next offset (null at the end)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100 and offset must not be negative")
    total = df.count()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    following = F.lit(offset + limit if total > offset + limit else None).cast("int")
    return rows.withColumns({"total": F.lit(total).cast("long"), "next_offset": following})


def search_history(runs: DataFrame, case: Column | None = None, invocation: object | None = None) -> DataFrame:
    """Runs of a case, their ``steps`` cut down to one planned invocation; runs left without steps go."""
    if case is not None:
        runs = runs.filter(case)
    if invocation is None:
        return runs
    return runs.withColumn("steps", F.filter("steps", lambda s: s["planned_invocation"] == invocation)).filter(F.size("steps") > 0)


def inspect_reports(reports: DataFrame) -> DataFrame:
    """A summary row per report with ``claims`` an array of ``claim_id, state, model``."""
    claims = F.coalesce(F.col("claims"), F.array())
    found = F.filter(claims, lambda c: c["state"] != "admitted")
    models = F.array_distinct(F.transform(claims, lambda c: c["model"]))
    return reports.select("attempt_id", "line", "status", F.size(claims).cast("long").alias("n_claims"), F.size(found).cast("long").alias("n_findings"), F.size(models).cast("long").alias("n_models"))


def report_view(reports: DataFrame, column: str, only: Column | None = None) -> DataFrame:
    """The items of one nested array as flat rows with the report's own columns; ``only`` may look at ``item``."""
    rows = reports.withColumn("item", F.explode(column)).drop(column)
    if only is not None:
        rows = rows.filter(only)
    return rows.select(*[c for c in rows.columns if c != "item"], "item.*")


def artifact_records(reports: DataFrame) -> DataFrame:
    """Documents, artifacts and supplied inputs of reports (three arrays of alike items) as flat rows with their ``kind``."""
    kinds = {"document": "documents", "artifact": "artifacts", "supplied_input": "supplied_inputs"}
    own = [c for c in reports.columns if c not in kinds.values()]
    tagged = [report_view(reports.select(*own, column), column).withColumn("kind", F.lit(kind)) for kind, column in kinds.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def workflow_view(reports: DataFrame) -> DataFrame:
    """The planned steps of reports with their bindings: a row for each binding, and one for a step without any."""
    steps = report_view(reports, "workflow")
    bound = steps.withColumn("binding", F.explode_outer("bindings")).drop("bindings")
    return bound.select(*[c for c in bound.columns if c != "binding"], "binding.*")


def revision_view(revisions: DataFrame, runs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Each revision, recorded or derived from a run, with the assessments that cite it, a row each; without any, one row."""
    found = resolve_revisions(revisions, runs, assessments)
    source = F.when(F.col("recorded"), "recorded").otherwise("derived")
    cited = assessments.select("revision_id", F.col("line").alias("assessment_line"), "run_id")
    return found.withColumn("source", source).drop("recorded", "last_assessment").join(cited, "revision_id", "left")


def assessment_view(assessments: DataFrame, runs: DataFrame, amendments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each assessment, compared by requirement with the run before it.

    ``assessments(revision_id, line, run_id)`` are recorded; a run without a revision
    (``runs(attempt_id, parent_id, line, revision_id)``) that none cites is one of its own.  A run that
    ``amendments(attempt_id, superseded_revision)`` names is compared across the amendment, any other with its parent.
    """
    cited = assessments.select(F.col("run_id").alias("attempt_id")).distinct().withColumn("recorded", F.lit(True))
    known = runs.join(cited, "attempt_id", "left").filter("recorded or revision_id is null")
    known = known.select("attempt_id", "parent_id", F.when(F.col("recorded"), "recorded").otherwise("derived").alias("source"))
    crossing = amendments.join(known.select("attempt_id"), "attempt_id", "left_semi")
    across = compare.cross_amendment_compare(crossing, assessments, verdicts).withColumn("crosses_amendment", F.lit(True))
    usual = compare.compare_attempts(known.join(crossing.select("attempt_id"), "attempt_id", "left_anti"), verdicts).withColumn("crosses_amendment", F.lit(False))
    return usual.unionByName(across).join(known.select("attempt_id", "source"), "attempt_id")


def reference_view(moves: DataFrame) -> DataFrame:
    """``name, target, line, n_moves, n_broken``: every name's binding now, and how many of its moves disagree with the one before."""
    history, broken = reference_history(moves)
    now = history.groupBy("name").agg(F.max_by(F.struct("target", "line"), "line").alias("now"), F.count(F.lit(1)).alias("n_moves"))
    bad = broken.groupBy("name").agg(F.count(F.lit(1)).alias("n_broken"))
    return now.join(bad, "name", "left").select("name", "now.*", "n_moves", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))
