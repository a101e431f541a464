"""Content-addressed trees, packages, receipts and replays: what is recorded against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.units import violations


def dedup_blobs(tree_files: DataFrame) -> DataFrame:
    """``sha256, n_refs, bytes, saved`` for each distinct content."""
    return tree_files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_refs"), F.max("bytes").alias("bytes"), (F.sum("bytes") - F.max("bytes")).alias("saved"))


def store_verify(tree_files: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sha256, finding`` for what is not as referenced, and one row of totals; ``blobs(sha256, observed_sha256, bytes)``."""
    wanted = tree_files.groupBy("sha256").agg(F.max("bytes").alias("want"), F.min("bytes").alias("least"), F.sum("bytes").alias("logical"))
    both = wanted.join(blobs.select("sha256", "observed_sha256", F.col("bytes").alias("have"), F.lit(True).alias("there")), "sha256", "full_outer")
    finding = (
        F.when(F.col("want").isNull(), "extra").when(F.col("there").isNull(), "missing").when(F.col("observed_sha256") != F.col("sha256"), "digest_mismatch")
        .when((F.col("have") != F.col("want")) | (F.col("least") != F.col("want")), "length_mismatch")
    )
    totals = both.agg(F.count("want").alias("n_distinct"), F.sum("logical").alias("logical_bytes"), F.sum("want").alias("distinct_bytes"), F.sum("have").alias("stored_bytes"))
    return both.select("sha256", finding.alias("finding")).filter("finding is not null"), totals


def package_integrity(manifest: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A state for each artifact and for each package.

    ``manifest(package_id, artifact_id, sha256)``, ``observed(package_id, artifact_id, sha256, checked, cached)``.
    """
    seen = observed.select("package_id", "artifact_id", F.col("sha256").alias("o_sha256"), "checked", "cached", F.lit(True).alias("there"))
    both = manifest.join(seen, ["package_id", "artifact_id"], "left")
    state = (
        F.when(F.col("there").isNull(), "missing").when(~F.col("checked"), "not_checked").when(F.col("sha256") != F.col("o_sha256"), "mismatch")
        .when(F.col("cached"), "verified_cached").otherwise("verified")
    )
    artifacts = both.select("package_id", "artifact_id", state.alias("state"))
    bad, open_ = F.bool_or(F.col("state").isin("missing", "mismatch")), F.bool_or(F.col("state") == "not_checked")
    return artifacts, artifacts.groupBy("package_id").agg(F.when(bad, "failed").when(open_, "partial").otherwise("complete").alias("state"))


def export_inventory(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Manifest rows with ``ok`` and ``bundle_ok``: one mismatch blocks the whole bundle."""
    both = manifest.join(observed.select("bundle_id", "path", F.col("sha256").alias("o_sha256"), F.col("bytes").alias("o_bytes")), ["bundle_id", "path"], "left")
    ok = F.coalesce((F.col("sha256") == F.col("o_sha256")) & (F.col("bytes") == F.col("o_bytes")), F.lit(False))
    rows = both.select("bundle_id", "path", ok.alias("ok"))
    return rows.join(rows.groupBy("bundle_id").agg(F.bool_and("ok").alias("bundle_ok")), "bundle_id")


def append_history(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """New records to append, and refused ones: an id that is there already, or came earlier in the batch.

    Null is an id like any other, and a null ``order`` comes last.  Of records of one id and order, the first by the other
    columns is accepted, so the two results share no record and leave none out.
    """
    named = {k: f"__{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(own)) for k, own in named.items()]
    first = new.groupBy(*keys).agg(F.min(order).alias("__first")).withColumnsRenamed(named)
    known = existing.select(*keys).distinct().withColumnsRenamed(named).withColumn("__known", F.lit(True))
    rows = new.join(first, same).drop(*named.values()).join(known, same, "left")
    fresh = F.col("__known").isNull() & F.col(order).eqNullSafe(F.col("__first"))
    # Only the first records of each id are told apart, so that an id with very many records is not sorted.
    rest = [c for c, kind in new.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    tied = rows.filter(fresh).withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest)))
    refused = rows.filter(~fresh).select(*new.columns).unionByName(tied.filter("__nth > 1").select(*new.columns))
    return tied.filter("__nth = 1").select(*new.columns), refused


def check_store_paths(tree_files: DataFrame) -> DataFrame:
    """``tree, path, problem``: path rules, one length per digest, no file that is also a folder."""
    p = F.col("path")
    parts = F.split(p, "/")
    lengths = tree_files.groupBy("sha256").agg(F.countDistinct("bytes").alias("n_lengths"))
    folders = tree_files.select("tree", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, 1, i), "/")))).alias("path")).filter("path <> ''").distinct().withColumn("is_folder", F.lit(True))
    rows = tree_files.join(lengths, "sha256", "left").join(folders, ["tree", "path"], "left")
    return violations(rows, ["tree", "path"], {
        "empty": p == "", "absolute": p.startswith("/"), "dot_segment": F.exists(parts, lambda s: s.isin(".", "..")), "empty_segment": (p != "") & F.exists(parts, lambda s: s == "") & ~p.startswith("/"),
        "control_character": p.rlike(r"[\x00-\x1f\x7f\\]"), "lengths_differ": F.col("n_lengths") > 1, "file_and_folder": F.col("is_folder").isNotNull(),
    })


def reuse_lookup(planned: DataFrame, receipts: DataFrame, observed: DataFrame) -> DataFrame:
    """``step_id, decision``: reuse a completed receipt of the same invocation whose outputs all verify.

    ``planned(step_id, invocation)``, ``receipts(receipt_id, invocation, status)``, ``observed(receipt_id, verified)``.
    """
    whole = observed.groupBy("receipt_id").agg(F.bool_and("verified").alias("whole"))
    done = receipts.filter("status = 'completed'").join(whole, "receipt_id", "left").groupBy("invocation").agg(F.bool_or(F.coalesce("whole", F.lit(False))).alias("whole"), F.min(F.when(F.col("whole"), F.col("receipt_id"))).alias("receipt_id"))
    both = planned.join(done, "invocation", "left")
    return both.select("step_id", F.when(F.col("whole").isNull(), "execute").when(F.col("whole"), "reuse").otherwise("outputs_changed").alias("decision"), F.when(F.col("whole"), F.col("receipt_id")).alias("receipt_id"))


def cached_digest_join(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """``inventory`` with ``sha256, state``: a recorded digest stands in where path, size, time and, if both sides have it, inode agree.

    Others are ``to_hash``.  Of several records of one stamp with unlike digests none is trusted.
    """
    stamp = ["path", "bytes", "mtime", *(["inode"] if "inode" in inventory.columns and "inode" in cache.columns else [])]
    known = cache.groupBy(*stamp).agg(F.min("sha256").alias("__low"), F.max("sha256").alias("__high")).filter("__low = __high")
    known = known.select(*[F.col(c).alias(f"__{c}") for c in stamp], F.col("__low").alias("sha256"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "inode" else F.col(c) == F.col(f"__{c}") for c in stamp]
    both = inventory.join(known, same, "left").drop(*[f"__{c}" for c in stamp])
    return both.withColumn("state", F.when(F.col("sha256").isNotNull(), "verified_cached").otherwise("to_hash"))


def verify_bindings(evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``evidence_id, state``: ``evidence(evidence_id, sha256, withheld)`` against ``artifacts(evidence_id, sha256, receipted)``."""
    a = artifacts.select("evidence_id", F.col("sha256").alias("a_sha256"), "receipted", F.lit(True).alias("has_artifact"))
    both = evidence.withColumn("has_evidence", F.lit(True)).join(a, "evidence_id", "full_outer")
    state = (
        F.when(F.col("has_evidence").isNull(), "unbound").when(F.col("withheld"), "withheld").when(F.col("has_artifact").isNull(), "unknown")
        .when(F.col("sha256") != F.col("a_sha256"), "digest_mismatch").when(F.col("receipted"), "receipted").otherwise("bound")
    )
    return both.select("evidence_id", state.alias("state"))


def verify_receipts(receipts: DataFrame, expected: DataFrame, slots: DataFrame, expected_slots: DataFrame) -> DataFrame:
    """``step_id, problem, detail``: ids, capability, exit status, invocation digest, and slots.

    ``receipts(step_id, case_id, capability, exit_status, invocation, derived_invocation)``,
    ``expected(step_id, case_id, capability)``, both slots ``(step_id, slot)``.
    """
    e = expected.select("step_id", F.col("case_id").alias("e_case"), F.col("capability").alias("e_capability"))
    own = violations(receipts.join(e, "step_id", "left"), ["step_id"], {
        "not_expected": F.col("e_case").isNull(), "case": F.col("case_id") != F.col("e_case"), "capability": F.col("capability") != F.col("e_capability"),
        "exit_status": ~F.col("exit_status").eqNullSafe(F.lit(0)), "invocation_digest": F.col("invocation") != F.col("derived_invocation"),
    }).withColumn("detail", F.lit(""))
    counts = slots.groupBy("step_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(expected_slots.distinct().withColumn("wanted", F.lit(True)), ["step_id", "slot"], "full_outer")
    problem = F.when(F.col("wanted").isNull(), "unexpected_slot").when(F.col("n").isNull(), "missing_slot").when(F.col("n") > 1, "duplicate_slot")
    return own.unionByName(both.select("step_id", problem.alias("problem"), F.col("slot").alias("detail")).filter("problem is not null"))


def replay_verdicts(recorded: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, replay``: recorded ``status, rule, margin`` against those derived again."""
    d = derived.select(*keys, *[F.col(c).alias(f"d_{c}") for c in ("status", "rule", "margin")], F.lit(True).alias("there"))
    both = recorded.join(d, keys, "left")
    same = F.col("status").eqNullSafe(F.col("d_status")) & F.col("rule").eqNullSafe(F.col("d_rule")) & F.col("margin").eqNullSafe(F.col("d_margin"))
    return both.select(*keys, F.when(F.col("there").isNull(), "not_checked").when(same, "verified").otherwise("mismatch").alias("replay"))


def derive_applications(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rule, conclusion, kind, id, state``: each verdict's rule with its premises, one a row."""
    premises = claims.select(*keys, F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), "state")
    return verdicts.select(*keys, "rule", F.col("status").alias("conclusion")).join(premises, keys)


def derivation_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, change, kinds`` between two sets of applications with premises: removed, added, conclusion or premises changed."""
    from assayer.operators.policy import changed_premise_kinds

    heads = lambda df, c: df.select(*keys, F.col("conclusion").alias(c)).distinct()
    both = heads(before, "old").join(heads(after, "new"), keys, "full_outer").join(changed_premise_kinds(before, after, keys), keys, "left")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "conclusion_changed").when(F.col("kinds").isNotNull(), "premises_changed")
    return both.select(*keys, change.alias("change"), F.when(change == "premises_changed", F.col("kinds")).alias("kinds")).filter("change is not null")


def lapsed_gates(gates: DataFrame, routed: DataFrame, now: Column) -> DataFrame:
    """``request_sha256, respond_by``: open gates past their deadline, one row a request."""
    late = gates.filter(F.col("respond_by") < now).groupBy("request_sha256").agg(F.min("respond_by").alias("respond_by"))
    return late.join(routed.select("request_sha256").distinct(), "request_sha256", "left_anti")


def classify_rows(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """``run_id, outcome``: refused, honest, reframed (another question) or undetected (changed but accepted).

    ``runs(run_id, case_id, status, snapshot, changed)``, ``reference(case_id, snapshot)``.
    """
    both = runs.join(reference.select("case_id", F.col("snapshot").alias("ref")), "case_id", "left")
    outcome = F.when(F.col("status") == "rejected", "refused").when(~F.col("snapshot").eqNullSafe(F.col("ref")), "reframed").when(F.col("changed"), "undetected").otherwise("honest")
    return both.select("run_id", outcome.alias("outcome"))


def explain_findings(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Findings with the catalogue's title and next action; codes that it lacks stay, marked."""
    both = findings.join(catalogue, "code", "left")
    return both.withColumn("explained", F.col("title").isNotNull())
