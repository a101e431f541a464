"""Lineage of runs: edge rules between a run and its parent, roots and leaves, ancestor chains, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.units import violations
from assayer.storage import materialize


def validate_lineage(runs: DataFrame) -> DataFrame:
    """``line, problem``: one self-join, every broken rule of a run a row.

    ``runs(line, attempt_id, generation, parent_id, parent_sha256, record_sha256, case_id, input_id,
    state_sha256, derived_sha256, n_changes, n_derived_changes)``.
    """
    parent = runs.select(F.col("attempt_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in ("line", "generation", "record_sha256", "case_id", "input_id")])
    both = runs.join(parent, "parent_id", "left")
    root, known = F.col("parent_id").isNull(), F.col("p_line").isNotNull()
    return violations(both, ["line"], {
        "root_generation": root & (F.col("generation") != 0),
        "root_changes": root & (F.col("n_changes") > 0),
        "parent_missing": ~root & ~known,
        "parent_not_earlier": known & (F.col("p_line") >= F.col("line")),
        "generation_step": known & (F.col("generation") != F.col("p_generation") + 1),
        "parent_digest": known & ~F.col("parent_sha256").eqNullSafe(F.col("p_record_sha256")),
        "fixed_identity": known & ~F.col("case_id").eqNullSafe(F.col("p_case_id")),
        "candidate_input": known & ~F.col("input_id").eqNullSafe(F.col("p_input_id")),
        "recorded_changes": known & (F.col("n_changes") != F.col("n_derived_changes")),
        "state_digest": ~F.col("state_sha256").eqNullSafe(F.col("derived_sha256")),
    })


def roots_and_leaves(runs: DataFrame) -> DataFrame:
    """``attempt_id, is_root, is_leaf`` of ``runs(attempt_id, parent_id)``."""
    parents = runs.select(F.col("parent_id").alias("attempt_id")).filter("attempt_id is not null").distinct().withColumn("has_child", F.lit(True))
    return runs.join(parents, "attempt_id", "left").select("attempt_id", F.col("parent_id").isNull().alias("is_root"), F.col("has_child").isNull().alias("is_leaf"))


def ancestors(edges: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """``node, ancestor, depth`` for the whole chain above every node.

    Pointer doubling: after k rounds the jumps span 2**k generations, so a chain of length d takes about
    log2(d) joins, each written to the shared folder.  Nodes of a cycle are not reported past its length.
    """
    jumps = materialize(edges.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")), "jumps")
    closed, span = jumps, 1
    while not jumps.isEmpty():
        onward = jumps.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        longer = closed.join(onward, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        closed = materialize(closed.unionByName(longer).filter("node <> ancestor").dropDuplicates(["node", "ancestor"]), "closed")
        jumps = materialize(jumps.join(onward, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).filter("node <> ancestor"), "jumps")
        span *= 2
        if span > 1 << 40:
            break
    return closed


def resolve_revisions(revisions: DataFrame, runs: DataFrame, assessments: DataFrame) -> DataFrame:
    """Recorded revisions and those that runs without one derive, with counts of children and assessments.

    ``revisions(revision_id, parent_id, line)``, ``runs(attempt_id, parent_id, line, revision_id)``,
    ``assessments(revision_id, line)``.
    """
    derived = runs.filter("revision_id is null").select(F.col("attempt_id").alias("revision_id"), "parent_id", "line", F.lit(False).alias("recorded"))
    every = revisions.select("revision_id", "parent_id", "line", F.lit(True).alias("recorded")).unionByName(derived)
    children = every.filter("parent_id is not null").groupBy(F.col("parent_id").alias("revision_id")).agg(F.count(F.lit(1)).alias("n_children"))
    assessed = assessments.groupBy("revision_id").agg(F.count(F.lit(1)).alias("n_assessments"), F.max("line").alias("last_assessment"))
    out = every.join(children, "revision_id", "left").join(assessed, "revision_id", "left")
    return out.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_assessments": F.coalesce("n_assessments", F.lit(0))})


def validate_revisions(revisions: DataFrame, runs: DataFrame, amendments: DataFrame) -> DataFrame:
    """``line, problem`` for ``revisions(line, revision_id, parent_id, generation, case_id, amendment_id)``."""
    parent = revisions.select(F.col("revision_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in ("line", "generation", "case_id")])
    run_ids = runs.select(F.col("attempt_id").alias("revision_id")).distinct().withColumn("is_run", F.lit(True))
    known = amendments.select("amendment_id", F.col("line").alias("a_line"))
    both = revisions.join(parent, "parent_id", "left").join(run_ids, "revision_id", "left").join(known, "amendment_id", "left")
    root, here = F.col("parent_id").isNull(), F.col("p_line").isNotNull()
    return violations(both, ["line"], {
        "root_generation": root & (F.col("generation") != 0),
        "parent_missing": ~root & ~here,
        "parent_not_earlier": here & (F.col("p_line") >= F.col("line")),
        "generation_step": here & (F.col("generation") != F.col("p_generation") + 1),
        "fixed_identity": here & ~F.col("case_id").eqNullSafe(F.col("p_case_id")),
        "amendment_on_child": ~root & F.col("amendment_id").isNotNull(),
        "amendment_missing": F.col("amendment_id").isNotNull() & F.col("a_line").isNull(),
        "amendment_not_earlier": F.col("a_line") >= F.col("line"),
        "id_is_a_run": F.col("is_run").isNotNull(),
    })


def validate_assessments(assessments: DataFrame, runs: DataFrame) -> DataFrame:
    """``line, problem`` for ``assessments(line, run_id, run_sha256, revision_id, verdicts)`` against
    ``runs(line, attempt_id, record_sha256, revision_id, verdicts)``; verdicts are canonical texts."""
    cited = runs.select(F.col("attempt_id").alias("run_id"), *[F.col(c).alias(f"r_{c}") for c in ("line", "record_sha256", "revision_id", "verdicts")])
    both = assessments.join(cited, "run_id", "left")
    here = F.col("r_line").isNotNull()
    return violations(both, ["line"], {
        "run_missing": ~here,
        "run_not_earlier": here & (F.col("r_line") >= F.col("line")),
        "run_digest": here & ~F.col("run_sha256").eqNullSafe(F.col("r_record_sha256")),
        "revision": here & ~F.col("revision_id").eqNullSafe(F.col("r_revision_id")),
        "verdicts_not_verbatim": here & ~F.col("verdicts").eqNullSafe(F.col("r_verdicts")),
    })


def validate_amendments(amendments: DataFrame, revisions: DataFrame) -> DataFrame:
    """``line, problem`` for ``amendments(line, superseded, case_id, actor, rationale)``: the target is an earlier root."""
    target = revisions.select(F.col("revision_id").alias("superseded"), F.col("line").alias("t_line"), F.col("parent_id").alias("t_parent"), F.col("case_id").alias("t_case"))
    both = amendments.join(target, "superseded", "left")
    here = F.col("t_line").isNotNull()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return violations(both, ["line"], {
        "target_missing": ~here,
        "target_not_earlier": here & (F.col("t_line") >= F.col("line")),
        "target_not_root": here & F.col("t_parent").isNotNull(),
        "identity": here & ~F.col("case_id").eqNullSafe(F.col("t_case")),
        "actor_empty": blank("actor"),
        "rationale_empty": blank("rationale"),
    })


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, combined before the shuffle, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def reference_history(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each name's moves with the binding before, and moves whose recorded ``superseded`` differs from it.

    ``moves(name, line, target, superseded)``.
    """
    before = F.lag("target").over(Window.partitionBy("name").orderBy("line"))
    out = moves.withColumn("previous", before)
    return out, out.filter(~F.col("superseded").eqNullSafe(F.col("previous"))).select("name", "line")
