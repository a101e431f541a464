"""Policies against floors, capability selection, reuse rules, routing and reproducibility checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.units import violations


def subset(a: Column, b: Column) -> Column:
    """Whether array ``a`` has nothing that ``b`` lacks; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(a, none), F.coalesce(b, none))) == 0


def stated(c: str) -> Column:
    """Whether a list is given; an empty or null one takes over the floor's."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def list_tightens(kind: str, own: str, floor: str) -> Column:
    """A stated deny list must hold the floor's, a stated allow list stay within a stated floor, grants within the floor."""
    if kind == "deny":
        return ~stated(own) | subset(F.col(floor), F.col(own))
    if kind == "allow":
        return ~stated(own) | ~stated(floor) | subset(F.col(own), F.col(floor))
    return subset(F.col(own), F.col(floor))


def policy_tightens(policies: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loosened fields (``policy_id, problem``), and the policies merged with their floors.

    Both have ``floor_id, deny_providers, allow_providers, permitted_roles, permit_nominal_basis,
    min_maturity, cost_cap, currency``; ``policies`` has ``policy_id``.
    """
    fields = [c for c in floors.columns if c != "floor_id"]
    both = policies.join(floors.select("floor_id", *[F.col(c).alias(f"f_{c}") for c in fields]), "floor_id")
    loosened = violations(both, ["policy_id"], {
        "deny_providers": ~list_tightens("deny", "deny_providers", "f_deny_providers"),
        "allow_providers": ~list_tightens("allow", "allow_providers", "f_allow_providers"),
        "permitted_roles": ~list_tightens("grant", "permitted_roles", "f_permitted_roles"),
        "permit_nominal_basis": F.coalesce("permit_nominal_basis", F.lit(False)) & ~F.coalesce("f_permit_nominal_basis", F.lit(False)),
        "min_maturity": F.col("min_maturity") < F.col("f_min_maturity"),
        "cost_cap": F.col("cost_cap").isNotNull() & F.col("f_cost_cap").isNotNull() & (~F.col("currency").eqNullSafe(F.col("f_currency")) | (F.col("cost_cap") > F.col("f_cost_cap"))),
    })
    none = F.array().cast("array<string>")
    lists = [F.when(stated(c), F.col(c)).otherwise(F.coalesce(F.col(f"f_{c}"), none)).alias(c) for c in ("deny_providers", "allow_providers", "permitted_roles")]
    nominal = F.coalesce("permit_nominal_basis", F.lit(False)) | F.coalesce("f_permit_nominal_basis", F.lit(False))
    merged = both.select("policy_id", *lists, nominal.alias("permit_nominal_basis"), *[F.coalesce(c, f"f_{c}").alias(c) for c in ("min_maturity", "cost_cap", "currency")])
    return loosened, merged


def selection_checks(selections: DataFrame, candidates: DataFrame, policies: DataFrame) -> DataFrame:
    """``step_id, problem`` of capability selections.

    ``selections(step_id, policy_id, winner, bound, confirmed, self_check, own)`` (``own``: the winner is the
    selector's); ``candidates(step_id, capability_id, decision, provider, maturity, cost, criteria, bytes)``;
    ``policies(policy_id, deny_providers, allow_providers, min_maturity, cost_cap, banned_criteria,
    known_criteria, forbid_self_preference, independent, diverse)``.
    """
    each = candidates.select("step_id", "decision", F.explode_outer("criteria").alias("criterion"))
    by_step = each.groupBy("step_id").agg(F.bool_or(F.col("decision").isNull()).alias("undecided"), F.collect_set("criterion").alias("used"))
    won = candidates.select("step_id", F.col("capability_id").alias("winner"), "provider", "maturity", "cost", "bytes")
    rows = selections.join(by_step, "step_id", "left").join(won, ["step_id", "winner"], "left").join(policies, "policy_id", "left")
    provider = F.col("provider")
    # Independence is asked within one policy's selections.  Counts are combined before their shuffle.
    for c, n in (("provider", "n_owner"), ("bytes", "n_bytes")):
        counts = rows.groupBy("policy_id", c).agg(F.count(c).alias(n))
        rows = rows.join(counts, ["policy_id", c], "left")
    return violations(rows, ["step_id"], {
        "undecided_candidate": F.col("undecided"),
        "banned_criterion": F.arrays_overlap("used", "banned_criteria"),
        "unknown_criterion": F.size(F.array_except("used", F.array_union("known_criteria", "banned_criteria"))) > 0,
        "no_winner": F.col("winner").isNull(),
        "winner_not_bound": F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("bound")),
        "provider_denied": F.array_contains("deny_providers", provider),
        "provider_not_allowed": stated("allow_providers") & ~F.array_contains("allow_providers", provider),
        "maturity_below_floor": F.col("min_maturity").isNotNull() & ~F.coalesce(F.col("maturity") >= F.col("min_maturity"), F.lit(False)),
        "self_preference_unchecked": F.col("forbid_self_preference") & F.col("own") & ~F.coalesce("self_check", F.lit(False)),
        "cost_over_cap": F.col("cost_cap").isNotNull() & ~F.coalesce(F.col("cost") <= F.col("cost_cap"), F.lit(False)) & ~F.coalesce("confirmed", F.lit(False)),
        "shared_provider": F.col("independent") & provider.isNotNull() & (F.col("n_owner") > 1),
        "identical_bytes": F.col("diverse") & F.col("bytes").isNotNull() & (F.col("n_bytes") > 1),
    })


def reuse_rule_filter(rules: DataFrame, edges: DataFrame, keys: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Usable reuse rules, and refused ones with their problems.

    ``rules(rule_id, src_step, dst_step, dst_slot, justification, evidence, not_after, key_id)``.
    """
    there = edges.select("src_step", "dst_step", "dst_slot").distinct().withColumn("edge", F.lit(True))
    known = keys.filter("role = 'policy_owner'").select("key_id").distinct().withColumn("key", F.lit(True))
    rows = rules.join(there, ["src_step", "dst_step", "dst_slot"], "left").join(known, "key_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    refused = violations(rows, ["rule_id"], {
        "not_justified": blank("justification"), "no_evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no_edge": F.col("edge").isNull(),
        "expired": now >= F.col("not_after"), "key_not_authorised": F.col("key").isNull(),
    })
    return rules.join(refused.select("rule_id").distinct(), "rule_id", "left_anti"), refused


def policy_document_diff(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``key, state``: in both, only required, or only present."""
    r, p = required.select(key).distinct(), present.select(key).distinct()
    tag = lambda df, s: df.withColumn("state", F.lit(s))
    return tag(r.intersect(p), "both").unionByName(tag(r.subtract(p), "missing")).unionByName(tag(p.subtract(r), "extra"))


def check_routing(records: DataFrame, gates: DataFrame) -> DataFrame:
    """``record_id, problem``: ``records(record_id, step_id, request_sha256, policy_id, disposition, reviewer_role,
    record_sha256, derived_sha256)`` against ``gates(step_id, request_sha256, policy_id, dispositions, role)``."""
    gate = gates.select("step_id", *[F.col(c).alias(f"g_{c}") for c in ("request_sha256", "policy_id", "dispositions", "role")])
    rows = records.join(gate, "step_id", "left")
    here = F.col("g_policy_id").isNotNull()
    return violations(rows, ["record_id"], {
        "no_gate": ~here, "request_digest": here & (F.col("request_sha256") != F.col("g_request_sha256")), "policy": here & (F.col("policy_id") != F.col("g_policy_id")),
        "disposition": here & ~F.array_contains("g_dispositions", F.col("disposition")), "reviewer_role": here & (F.col("reviewer_role") != F.col("g_role")),
        "record_digest": F.col("record_sha256") != F.col("derived_sha256"),
    })


def check_reproducibility(steps: DataFrame, declared: DataFrame, present: DataFrame) -> DataFrame:
    """``step_id, problem``: ``steps(step_id, class, seed, role, permitted_roles)``, factors ``(step_id, factor)`` declared and present."""
    lost = declared.join(present, ["step_id", "factor"], "left_anti").select("step_id", F.lit("factor_missing").alias("problem")).distinct()
    more = present.join(declared, ["step_id", "factor"], "left_anti").select("step_id", F.lit("factor_extra").alias("problem")).distinct()
    own = violations(steps, ["step_id"], {
        "seed_missing": (F.col("class") == "seeded") & F.col("seed").isNull(),
        "seed_not_expected": (F.col("class") != "seeded") & F.col("seed").isNotNull(),
        "nondeterministic_role": (F.col("class") == "nondeterministic") & ~F.array_contains("permitted_roles", F.col("role")),
    })
    return own.unionByName(lost).unionByName(more)


def artifact_view(documents: DataFrame, artifacts: DataFrame, supplied: DataFrame) -> DataFrame:
    """``kind, id, sha256`` of all three."""
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "id", "sha256")
    return tag(documents, "document").unionByName(tag(artifacts, "artifact")).unionByName(tag(supplied, "supplied_input"))


def changed_premise_kinds(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kinds``: premise kinds whose sets of ``(id, state)`` differ; both ``(keys, kind, id, state)``."""
    cols = [*keys, "kind", "id", "state"]
    a, b = before.select(*cols).distinct(), after.select(*cols).distinct()
    changed = a.exceptAll(b).unionByName(b.exceptAll(a))
    return changed.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
