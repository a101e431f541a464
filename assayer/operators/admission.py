"""Admission of inputs and claims, binding, coverage, qualification, and checks of ids and values.

Rules are columns over joined rows, so a row can break several; reasons are arrays in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.units import violations
from assayer.storage import Parts, materialize

# The forms of identifiers and digests, and the order of bases.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
DIGEST = r"^sha256:[0-9a-f]{64}$"
#: How strong a basis is.
BASIS_RANK = {"nominal": 0, "bounded": 1, "enclosure": 2}


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def basis_rank(basis: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BASIS_RANK.items() for x in kv]), basis)


def admit_inputs(inputs: DataFrame, attestations: DataFrame) -> DataFrame:
    """``input_id, state, reasons`` for ``inputs(input_id, media_type)`` and ``attestations(input_id, sha256, media_type)``."""
    given = attestations.groupBy("input_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("sha256").rlike(DIGEST), F.lit(False))).alias("well_formed"), F.collect_set("media_type").alias("types"))
    both = inputs.join(given, "input_id", "left")
    found = reasons({
        "duplicate_attestation": F.col("n") > 1,
        "malformed_digest": ~F.col("well_formed"),
        "media_type_mismatch": F.exists("types", lambda t: t != F.col("media_type")),
    })
    state = F.when(F.col("n").isNull(), "missing").when(F.size(found) > 0, "quarantined").otherwise("admitted")
    return both.select("input_id", state.alias("state"), F.coalesce(found, F.array().cast("array<string>")).alias("reasons"))


def admit_claims(claims: DataFrame, slots: DataFrame, edges: DataFrame, inputs: DataFrame, shape_ok: Column) -> DataFrame:
    """``claim_id, state, reasons``: local rules first, then parents, level by level.

    ``claims(claim_id, step_id, slot, media_type, model, partial)``, ``slots(step_id, slot, media_type,
    models, partial_allowed)``, ``edges(step_id, parent_step, parent_input)`` (one of the two set),
    ``inputs(input_id, state)``.  A step fails as soon as any parent step has a claim that fails, so failures
    spread along edges until nothing changes: one join a level, however wide the levels are.
    """
    on = ["step_id", "slot"]
    many = F.count(F.lit(1)).over(Window.partitionBy(*on))
    # Slots follow the data, and Spark takes exploded lists for as small as the rows that they come from, so it might broadcast them.
    declared = slots.withColumnRenamed("media_type", "slot_type").withColumn("declared", F.lit(True)).hint("merge")
    rows = claims.withColumn("n_in_slot", many).join(declared, on, "left")
    local = reasons({
        "undeclared_slot": F.col("declared").isNull(),
        "duplicate_claim": F.col("n_in_slot") > 1,
        "media_type_mismatch": F.col("media_type") != F.col("slot_type"),
        "partial_not_permitted": F.col("partial") & ~F.coalesce(F.col("partial_allowed"), F.lit(False)),
        "model_not_permitted": ~F.array_contains("models", F.col("model")),
        "claim_shape": ~shape_ok,
    })
    judged = materialize(rows.select("claim_id", "step_id", local.alias("local")), "claims-local")
    bad_inputs = edges.join(inputs.filter("state <> 'admitted'").select(F.col("input_id").alias("parent_input")), "parent_input").select("step_id")
    wrong = judged.filter(F.size("local") > 0).select("step_id")
    below = edges.filter("parent_step is not null").select(F.col("parent_step"), "step_id")
    first = wrong.union(bad_inputs).distinct()
    failed = Parts(claims.sparkSession, "failed", first.schema)
    frontier = failed.add(first)
    while not frontier.isEmpty():
        reached = frontier.withColumnRenamed("step_id", "parent_step").join(below, "parent_step").select("step_id").distinct()
        frontier = failed.add(reached.join(failed.rows(), "step_id", "left_anti"))
    # A step is blocked by a bad input or a failed parent, not by what is wrong with itself.
    blocked = bad_inputs.union(failed.rows().withColumnRenamed("step_id", "parent_step").join(below, "parent_step").select("step_id")).distinct()
    out = judged.join(blocked.withColumn("parent_failed", F.lit(True)), "step_id", "left")
    every = F.concat("local", F.when(F.col("parent_failed"), F.array(F.lit("parent_not_admitted"))).otherwise(F.array().cast("array<string>")))
    return out.select("claim_id", F.when(F.size(every) > 0, "quarantined").otherwise("admitted").alias("state"), every.alias("reasons"))


def parents_admitted(claims: DataFrame, edges: DataFrame, admitted: DataFrame) -> DataFrame:
    """``step_id, n_open``: steps of ``claims`` with a parent that is not admitted; ``edges(step_id, parent)``, ``admitted(parent)``."""
    open_edges = edges.join(admitted.select("parent").distinct(), "parent", "left_anti")
    counts = open_edges.groupBy("step_id").agg(F.count(F.lit(1)).alias("n_open"))
    return claims.select("step_id").distinct().join(counts, "step_id")


def unconsumed(declared: DataFrame, *used: DataFrame) -> DataFrame:
    """Rows of ``declared(kind, id)`` that no binding or metric uses."""
    every = used[0]
    for u in used[1:]:
        every = every.unionByName(u)
    return declared.join(every.distinct(), ["kind", "id"], "left_anti")


def auto_bind(slots: DataFrame, sources: DataFrame, explicit: DataFrame) -> DataFrame:
    """``slot_id, source_id, outcome, n_candidates``: a slot without explicit binding takes its only candidate of the right role.

    ``slots(slot_id, role)``, ``sources(source_id, role)``, ``explicit(slot_id, source_id)``.
    """
    open_slots = slots.join(explicit.select("slot_id"), "slot_id", "left_anti")
    by_role = sources.groupBy("role").agg(F.count(F.lit(1)).alias("n_candidates"), F.min("source_id").alias("only"))
    found = open_slots.join(by_role, "role", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    outcome = F.when(F.col("n_candidates") == 1, "bound").when(F.col("n_candidates") == 0, "none").otherwise("ambiguous")
    auto = found.select("slot_id", F.when(F.col("n_candidates") == 1, F.col("only")).alias("source_id"), outcome.alias("outcome"), "n_candidates")
    given = slots.join(explicit, "slot_id").select("slot_id", "source_id", F.lit("explicit").alias("outcome"), F.lit(None).cast("long").alias("n_candidates"))
    return auto.unionByName(given)


def qualification_as_of(claims: DataFrame, qualifications: DataFrame) -> DataFrame:
    """Claims with their record's state when they were evaluated: expired from ``not_after`` on."""
    both = claims.join(qualifications.select("qualification_id", "not_after"), "qualification_id", "left")
    state = F.when(F.col("not_after").isNull() & F.col("qualification_id").isNull(), "none").when(F.col("evaluated_at") >= F.col("not_after"), "expired").otherwise("current")
    return both.withColumn("qualification_state", state)


def attach_qualifications(records: DataFrame, steps: DataFrame) -> DataFrame:
    """Records with the step slots that they cover: capability and executable must both agree; no slots listed means all.

    A step has a row for each record of its executable, as its question asks; executables have few records.

    ``records(record_id, capability_id, executable, covered_slots)``, ``steps(step_id, slot, capability_id, executable)``.
    """
    both = steps.join(records, ["capability_id", "executable"])
    return both.filter(F.coalesce(F.array_contains("covered_slots", F.col("slot")), F.lit(True))).select("step_id", "slot", "record_id")


def envelope_state(terms: DataFrame, records: DataFrame) -> DataFrame:
    """``record_id, state`` from ``terms(record_id, truth)`` (null is unknown) and ``records(record_id, expired)``."""
    code = F.when(F.col("truth").isNull(), 1).when(F.col("truth"), 2).otherwise(0)
    least = terms.groupBy("record_id").agg(F.min(code).alias("least"))
    both = records.join(least, "record_id", "left")
    return both.select("record_id", F.when(F.col("expired"), "expired").when(F.col("least") == 0, "outside").when(F.col("least") == 1, "unknown").otherwise("inside").alias("state"))


def supersession_state(qualifications: DataFrame, revocations: DataFrame) -> DataFrame:
    """``record_id, state``: revoked before superseded before live; ``supersedes`` lists digests."""
    dead = qualifications.select(F.explode("supersedes").alias("record_sha256")).distinct().withColumn("superseded", F.lit(True))
    gone = revocations.select("record_sha256").distinct().withColumn("revoked", F.lit(True))
    both = qualifications.join(dead, "record_sha256", "left").join(gone, "record_sha256", "left")
    return both.select("record_id", F.when(F.col("revoked"), "revoked").when(F.col("superseded"), "superseded").otherwise("live").alias("state"))


# States of a qualification from worst to best.
GATE = ("not_recognised", "revoked", "superseded", "expired", "outside", "unknown", "inside")


def qualification_gate(requirements: DataFrame, claims: DataFrame) -> DataFrame:
    """``requirement_id, rule, notice``: the worst state of the claims' qualifications decides before the verdict.

    ``requirements(requirement_id, basis, categorical, qualification_required)``, ``claims(requirement_id,
    qualification_state)``, null where a claim has none.  A nominal basis passes; a claim without assessment
    stops a requirement only if that demands one (categorical ones never), else it is a notice.
    """
    rank = F.array_position(F.array(*map(F.lit, GATE)), F.col("qualification_state"))
    worst = claims.groupBy("requirement_id").agg(F.min(rank).alias("worst"), F.bool_or(F.col("qualification_state").isNull()).alias("bare"), F.count(F.lit(1)).alias("n"))
    both = requirements.join(worst, "requirement_id", "left")
    stopped = (F.col("basis") != "nominal") & (F.col("worst") < len(GATE))
    bare = (F.col("basis") != "nominal") & F.coalesce("bare", F.lit(False))
    rule = F.when(stopped, F.concat(F.lit("not_evaluated."), F.element_at(F.array(*map(F.lit, GATE)), F.col("worst").cast("int")))).when(bare & F.col("qualification_required") & ~F.col("categorical"), "not_evaluated.unqualified")
    return both.select("requirement_id", rule.alias("rule"), (rule.isNull() & bare).alias("notice"))


def assess_coverage(entries: DataFrame, mapping: DataFrame, omissions: DataFrame, requirements: DataFrame) -> DataFrame:
    """``set_id, state, n_issues`` for each set entry.

    ``entries(set_id, kind, comparison, minimum_basis, may_omit)``, ``mapping(set_id, requirement_id)``,
    ``omissions(set_id, reason, accepted_by)``, ``requirements(requirement_id, kind, comparison, basis)``.
    """
    asked = entries.join(mapping, "set_id").join(requirements.select("requirement_id", F.col("kind").alias("r_kind"), F.col("comparison").alias("r_comparison"), "basis"), "requirement_id", "left")
    fits = (F.col("r_kind") == F.col("kind")) & (F.col("r_comparison") == F.col("comparison"))
    enough = fits & (basis_rank(F.col("basis")) >= basis_rank(F.col("minimum_basis")))
    mapped = asked.groupBy("set_id").agg(F.bool_or(F.coalesce(fits, F.lit(False))).alias("covers"), F.bool_or(F.coalesce(enough, F.lit(False))).alias("adequate"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("misfits"))
    said = omissions.filter("trim(reason) <> '' and trim(accepted_by) <> ''").join(mapping.select("set_id").distinct(), "set_id", "left_anti").select("set_id").distinct().withColumn("stated", F.lit(True))
    both = entries.join(mapped, "set_id", "left").join(said, "set_id", "left")
    state = (
        F.when(F.col("adequate"), "covered").when(F.col("covers"), "covered_under_basis").when(F.col("stated"), "omitted_stated")
        .when(F.col("may_omit"), "omissible").otherwise("omitted_unstated")
    )
    issues = F.coalesce("misfits", F.lit(0)) + state.isin("covered_under_basis", "omitted_unstated").cast("long")
    return both.select("set_id", state.alias("state"), issues.alias("n_issues"))


def additional_requirements(requirements: DataFrame, mapping: DataFrame) -> DataFrame:
    """Requirements that no set entry claims."""
    return requirements.join(mapping.select("requirement_id").distinct(), "requirement_id", "left_anti").select("requirement_id")


def authorize_keys(signed: DataFrame, trust_root: DataFrame, required_role: str) -> DataFrame:
    """``record_id, decision``: the key must be listed, under the role; ``trust_root(key_id, role)``."""
    listed = trust_root.groupBy("key_id").agg(F.bool_or(F.col("role") == required_role).alias("fits"))
    both = signed.join(listed, "key_id", "left")
    return both.select("record_id", F.when(F.col("fits").isNull(), "unknown_key").when(F.col("fits"), "authorized").otherwise("wrong_role").alias("decision"))


def check_identifiers(df: DataFrame, ids: list[str], digests: list[str], key: str) -> DataFrame:
    """``key, problem`` for every malformed identifier or digest; null values pass."""
    rules = {f"bad_id:{c}": ~F.col(c).cast("string").rlike(IDENTIFIER) for c in ids} | {f"bad_digest:{c}": ~F.col(c).rlike(DIGEST) for c in digests}
    return violations(df, [key], rules)


def check_value_domains(values: DataFrame, domains: DataFrame) -> DataFrame:
    """``value_id, problem``: below or above a bound (exclusive unless flagged), not a member, or no domain at all.

    ``values(value_id, param, number, text)``, ``domains(param, low, low_inclusive, high, high_inclusive, members)``.
    """
    both = values.join(domains.withColumn("known", F.lit(True)), "param", "left")
    n = F.col("number")
    return violations(both, ["value_id"], {
        "no_domain": F.col("known").isNull(),
        "below": F.when(F.col("low_inclusive"), n < F.col("low")).otherwise(n <= F.col("low")),
        "above": F.when(F.col("high_inclusive"), n > F.col("high")).otherwise(n >= F.col("high")),
        "not_a_member": ~F.array_contains("members", F.col("text")),
    })


def find_duplicate_ids(df: DataFrame, key: str, place: str) -> DataFrame:
    """``key, n, first_place, last_place`` of ids that occur more than once; places stay a join away."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first_place"), F.max(place).alias("last_place")).filter("n > 1")


def contradictions(assumptions: DataFrame) -> DataFrame:
    """``proposition, scope, n_for, n_against`` where both stand; ``assumptions(id, proposition, scope, asserted)``."""
    sides = assumptions.groupBy("proposition", "scope").agg(F.count_if("asserted").alias("n_for"), F.count_if(~F.col("asserted")).alias("n_against"))
    return sides.filter("n_for > 0 and n_against > 0")
