"""State transitions of subjects: vocabulary, legal edges, continuity, derived states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.lineage import latest_per_key
from assayer.operators.ordered import scan
from assayer.operators.units import violations

# The states of each subject kind, where it begins, and the moves that it allows.
STATES = {
    "campaign": ["planned", "running", "blocked", "completed", "cancelled", "superseded", "invalidated"],
    "contract": ["draft", "in_review", "approved", "retired"],
    "step": ["pending", "reused", "staged", "running", "collecting", "validating", "admitted", "quarantined", "failed", "skipped", "cancelled"],
}
INITIAL = {"campaign": "planned", "contract": "draft", "step": "pending"}
LEGAL = [
    ("campaign", "planned", "running"), ("campaign", "planned", "cancelled"), ("campaign", "running", "blocked"), ("campaign", "running", "completed"),
    ("campaign", "running", "cancelled"), ("campaign", "running", "superseded"), ("campaign", "blocked", "running"), ("campaign", "blocked", "cancelled"),
    ("campaign", "blocked", "superseded"), ("campaign", "completed", "invalidated"),
    ("contract", "draft", "in_review"), ("contract", "in_review", "draft"), ("contract", "in_review", "approved"), ("contract", "approved", "retired"),
    *[("step", s, "cancelled") for s in STATES["step"] if s != "cancelled"],
]
ROLES = {"contract": "requester", "campaign": "requester", "step": "runner"}


def legal_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEGAL, "subject_kind string, from_state string, to_state string")


def initial_state(kind):
    return F.element_at(F.create_map(*[F.lit(x) for kv in INITIAL.items() for x in kv]), kind)


def with_previous(transitions: DataFrame, order: list[str]) -> DataFrame:
    """``transitions`` with ``derived_state``: the subject's state before the move.  ``order`` ends in a column that tells ties apart."""
    found = scan(transitions, order, ["subject_kind", "subject"], __previous=("previous", F.col("to_state")))
    return found.withColumn("derived_state", F.coalesce("__previous", initial_state(F.col("subject_kind")))).drop("__previous")


def transition_continuity(transitions: DataFrame, order: list[str]) -> DataFrame:
    """Moves whose recorded ``from_state`` is not the state that the subject had."""
    return with_previous(transitions, order).filter(~F.col("from_state").eqNullSafe(F.col("derived_state")))


def derived_state(transitions: DataFrame, order: list[str]) -> DataFrame:
    """The state of each subject after its last move."""
    return latest_per_key(transitions.select("subject_kind", "subject", *order, "to_state"), ["subject_kind", "subject"], order).select("subject_kind", "subject", F.col("to_state").alias("state"))


def required_role(kind, to_state):
    return F.when((kind == "campaign") & (to_state == "invalidated"), "policy_owner").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), kind))


def check_transitions(transitions: DataFrame, attestations: DataFrame, order: list[str]) -> DataFrame:
    """``transition_id, problem``: states, continuity, legal moves, and the attestation's digest and role.

    ``transitions(transition_id, subject_kind, subject, from_state, to_state, attestation_id,
    attestation_sha256)``, ``attestations(attestation_id, record_sha256, role)``.
    """
    legal = legal_edges(transitions.sparkSession).withColumn("legal", F.lit(True))
    signed = attestations.select("attestation_id", F.col("record_sha256").alias("a_sha256"), F.col("role").alias("a_role"))
    known = F.element_at(F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("subject_kind"))
    rows = with_previous(transitions, order).join(F.broadcast(legal), ["subject_kind", "from_state", "to_state"], "left").join(signed, "attestation_id", "left")
    return violations(rows, ["transition_id"], {
        "unknown_state": ~(F.array_contains(known, F.col("from_state")) & F.array_contains(known, F.col("to_state"))),
        "discontinuous": ~F.col("from_state").eqNullSafe(F.col("derived_state")),
        "illegal_move": F.col("legal").isNull(),
        "attestation_missing": F.col("a_sha256").isNull(),
        "attestation_digest": F.col("a_sha256") != F.col("attestation_sha256"),
        "attestation_role": F.col("a_role") != required_role(F.col("subject_kind"), F.col("to_state")),
    })
