"""Comparison of verdict sets: a run with its parent, or across an amendment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_verdict_sets(parent: DataFrame, child: DataFrame, keys: list[str], requirement: str = "requirement_id") -> DataFrame:
    """One row per pair of runs and requirement that either side has.

    Both sides have ``keys`` (which pair the runs), ``requirement``, ``status``, ``margin``, ``unit``,
    ``limit`` and ``categorical``.  The delta is exact; where there is none, ``unavailable`` says why.
    """
    on = [*keys, requirement]
    side = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("status", "margin", "unit", "limit", "categorical")], F.lit(True).alias(f"{p}_here"))
    both = side(parent, "parent").join(side(child, "child"), on, "full_outer")
    no_parent, no_child = F.col("parent_margin").isNull(), F.col("child_margin").isNull()
    delta = F.try_subtract(F.col("child_margin"), F.col("parent_margin"))
    unavailable = (
        F.when(F.col("child_here").isNull(), "child_missing")
        .when(F.col("parent_here").isNull(), "parent_missing")
        .when(no_parent & no_child & (F.col("parent_categorical") | F.col("child_categorical")), "not_numeric")
        .when(no_parent & no_child, "both_missing")
        .when(no_parent, "parent_missing")
        .when(no_child, "child_missing")
        .when(~F.col("parent_unit").eqNullSafe(F.col("child_unit")), "unit_mismatch")
        .when(~F.col("parent_limit").eqNullSafe(F.col("child_limit")), "limit_mismatch")
        .when(delta.isNull(), "invalid_number")
    )
    compared = F.col("parent_here") & F.col("child_here")
    change = F.when(compared & (F.col("parent_status") != F.col("child_status")), F.concat_ws(">", "parent_status", "child_status")).when(compared, "unchanged")
    return both.select(*on, "parent_status", "child_status", change.alias("transition"), F.when(unavailable.isNull(), delta).alias("delta"), unavailable.alias("unavailable"))


def compare_attempts(runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every run that has a parent, compared with it: ``runs(attempt_id, parent_id)``, ``verdicts`` by ``attempt_id``."""
    pairs = runs.filter("parent_id is not null").select("attempt_id", "parent_id")
    child = pairs.join(verdicts, "attempt_id")
    parent = pairs.join(verdicts.withColumnRenamed("attempt_id", "parent_id"), "parent_id")
    return compare_verdict_sets(parent, child, ["attempt_id", "parent_id"])


def cross_amendment_compare(amendments: DataFrame, assessments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A new root, compared with the latest assessment of the root that its amendment supersedes.

    ``amendments(attempt_id, superseded_revision)``, ``assessments(revision_id, line, run_id)``.
    """
    latest = assessments.groupBy("revision_id").agg(F.max_by("run_id", "line").alias("parent_id"))
    pairs = amendments.join(latest, amendments["superseded_revision"] == latest["revision_id"]).select("attempt_id", "parent_id")
    return compare_attempts(pairs, verdicts)


def requirement_report(definitions: DataFrame, verdicts: DataFrame, admissions: DataFrame) -> DataFrame:
    """Definitions and verdicts, each kept without the other, with the claims admitted and not.

    Joined on ``requirement_id``; ``admissions(requirement_id, claim_id, state)``.
    """
    seen = admissions.groupBy("requirement_id").agg(F.count_if(F.col("state") == "admitted").alias("n_admitted"), F.count_if(F.col("state") != "admitted").alias("n_not_admitted"))
    both = definitions.withColumn("defined", F.lit(True)).join(verdicts, "requirement_id", "full_outer").join(seen, "requirement_id", "left")
    return both.withColumns({"defined": F.coalesce("defined", F.lit(False)), "n_admitted": F.coalesce("n_admitted", F.lit(0)), "n_not_admitted": F.coalesce("n_not_admitted", F.lit(0))})


def missing_references(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose (non-null) key no row of ``parent`` has."""
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def precedes_check(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``line, ref, problem`` for ``refs(line, ref)`` whose target ``rows(id, line)`` is absent or not earlier."""
    first = rows.groupBy("id").agg(F.min("line").alias("target_line"))
    found = refs.join(first, refs["ref"] == first["id"], "left")
    problem = F.when(F.col("target_line").isNull(), "missing").when(F.col("target_line") >= F.col("line"), "not_earlier")
    return found.select("line", "ref", problem.alias("problem")).filter("problem is not null")


def verdict_side(verdicts: DataFrame, unit: Column, limit: Column) -> DataFrame:
    """Verdicts with the columns that a comparison looks at."""
    return verdicts.withColumns({"unit": unit, "limit": limit, "categorical": F.lit(False)})
