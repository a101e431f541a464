"""Claims against slots: what is joined, and how."""

from pyspark.sql import functions as F

from assayer.operators import admission
from assayer.operators.verdicts import _shape_ok

CLAIMS = "claim_id long, step_id long, slot long, media_type string, model string, partial boolean, nominal_minor long, lower_minor long, upper_minor long, coverage double"


def test_slots_from_lists_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded lists for as small as the rows that they come from, so its estimate must not decide."""
    claims = spark.createDataFrame([(10 * s + k, s, k, "json", "exact", False, 1, None, None, None) for s in range(4) for k in (0, 1, 99 if s == 2 else 2)], CLAIMS)
    steps = spark.range(4).withColumnRenamed("id", "step_id")
    slots = steps.select("step_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("slot"), F.lit("json").alias("media_type"), F.array(F.lit("exact")).alias("models"), F.lit(False).alias("partial_allowed"))
    edges = spark.createDataFrame([(3, 2, None), (1, None, 7)], "step_id long, parent_step long, parent_input long")
    inputs = spark.createDataFrame([(7, "admitted")], "input_id long, state string")
    plans, write = [], admission.materialize

    def seen(df, *names):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *names)

    monkeypatch.setattr(admission, "materialize", seen)
    found = {r.claim_id: r.reasons for r in admission.admit_claims(claims, slots, edges, inputs, _shape_ok()).collect()}
    assert plans and not any("Broadcast" in p for p in plans)
    assert {k: v for k, v in found.items() if v} == {119: ["undeclared_slot"]} | {k: ["parent_not_admitted"] for k in (30, 31, 32)} and len(found) == 12
