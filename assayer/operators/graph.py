"""Graph closures over bindings and dependencies, by frontier loops of joins.

Each round is a join of the frontier with the edges and an anti-join with what is known, written to the
shared folder; counts alone come to the driver.  Rounds follow the depth of the graph, not its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.storage import Parts, materialize


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node`` for everything reachable from ``start(node)`` along ``edges(src, dst)``, starts included."""
    first = start.select("node").distinct()
    known = Parts(edges.sparkSession, "reach", first.schema)
    frontier = known.add(first)
    links = edges.select(F.col("src").alias("node"), "dst")
    while not frontier.isEmpty():
        onward = frontier.join(links, "node").select(F.col("dst").alias("node")).distinct()
        frontier = known.add(onward.join(known.rows(), "node", "left_anti"))
    return known.rows()


def impact_propagation(edges: DataFrame, changed: DataFrame, exempt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps that a change reaches, and the edges that condemn them.

    ``edges(src_step, dst_step, dst_slot)``, ``changed(step_id)`` as first condemned steps; ``exempt`` lists
    edges that pass nothing on.
    """
    live = edges.join(exempt.select("src_step", "dst_step", "dst_slot").distinct(), ["src_step", "dst_step", "dst_slot"], "left_anti")
    hit = reach(live.select(F.col("src_step").alias("src"), F.col("dst_step").alias("dst")), changed.select(F.col("step_id").alias("node")))
    condemning = live.join(hit.select(F.col("node").alias("src_step")), "src_step")
    return hit.select(F.col("node").alias("step_id")), condemning


def rerun_subgraph(steps: DataFrame, impacted: DataFrame, durations: DataFrame) -> DataFrame:
    """One row: steps to run and to reuse, their summed recorded duration (null if any is missing), and how many lack one."""
    rows = steps.join(impacted.withColumn("rerun", F.lit(True)), "step_id", "left").join(durations, "step_id", "left")
    again = F.coalesce("rerun", F.lit(False))
    missing = F.count_if(again & F.col("duration_ms").isNull())
    return rows.agg(F.count_if(again).alias("n_run"), F.count_if(~again).alias("n_reuse"), F.when(missing == 0, F.coalesce(F.sum(F.when(again, F.col("duration_ms"))), F.lit(0))).alias("duration_ms"), missing.alias("n_without_estimate"))


def topological_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, level`` (longest path from a source) for what is above any cycle, and ``node`` for the rest.

    Nodes without open predecessors are peeled off level by level; those never peeled lie on a cycle or below one;
    :func:`detect_cycles` tells these apart.
    """
    links = materialize(edges.select("src", "dst").distinct(), "links")
    # What is left of a node: the predecessors that are not peeled yet.  Only those of the last level's successors change.
    nodes = materialize(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "nodes")
    spark, level = edges.sparkSession, 0
    done = Parts(spark, "levels", nodes.withColumn("level", F.lit(0)).schema)
    ready = done.add(nodes.join(links.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)))
    while not ready.isEmpty():
        level += 1
        peeled = done.rows().select(F.col("node").alias("src"))
        below = ready.select(F.col("node").alias("src")).join(links, "src").select("dst").distinct()
        held = links.join(below, "dst", "left_semi").join(peeled, "src", "left_anti").select("dst").distinct()
        ready = done.add(below.join(held, "dst", "left_anti").select(F.col("dst").alias("node"), F.lit(level).alias("level")))
    return done.rows(), nodes.join(done.rows().select("node"), "node", "left_anti")


def _trimmed(links: DataFrame, rounds: int) -> DataFrame:
    """``links`` without those that no cycle can use: into nodes that lead nowhere or out of nodes that nothing leads to."""
    for _ in range(rounds):
        onward = links.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        links = materialize(onward.join(onward.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "links")
    return links


def _coloured(links: DataFrame) -> DataFrame:
    """``node, colour``: the greatest node that leads to each, itself included.  Only nodes whose colour rose pass it on."""
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    known = Parts(links.sparkSession, "colours", nodes.withColumn("colour", F.col("node")).schema)
    risen = known.add(nodes.withColumn("colour", F.col("node")))
    while not risen.isEmpty():
        offered = risen.join(links.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        now = known.rows().groupBy("node").agg(F.max("colour").alias("held"))
        risen = known.add(offered.join(now, "node").filter("colour > held").select("node", "colour"))
    return known.rows().groupBy("node").agg(F.max("colour").alias("colour"))


def detect_cycles(edges: DataFrame, trims: int = 2) -> DataFrame:
    """``node, component, on_cycle`` for every node of ``edges(src, dst)``.

    Nodes that reach each other are a component, named after its least node; a node is on a cycle if it reaches
    itself, so nodes below a cycle are told apart from those on it.  Each round trims what no cycle can use,
    gives every node the greatest node that leads to it as colour, and walks back from the node that has its own
    colour, within the colour: what it meets is a component.  Colours never share a component, so links between them
    go.  Rounds of a walk follow the length of paths inside the cyclic part, not the size of the graph.
    """
    spark = edges.sparkSession
    links = materialize(edges.filter("src is not null and dst is not null").select("src", "dst").distinct(), "links")
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    found = Parts(spark, "components", nodes.withColumn("component", F.col("node")).schema)
    live = _trimmed(links.filter("src <> dst"), trims)
    while not live.isEmpty():
        colours = materialize(_coloured(live), "colours")
        ends = live.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("src_colour")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("dst_colour")), "dst")
        inside = materialize(ends.filter("src_colour = dst_colour").select("src", "dst"), "links")  # read each round of the walk
        # Walking back inside its colour, only the component of the colour's own node is met.
        back = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours.filter("node = colour").select("node"))
        met = materialize(back.join(colours, "node"), "met")
        least = met.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        found.add(met.join(least, "colour").select("node", "component"))
        left = inside.join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = _trimmed(left, trims)
    own = links.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loops"))
    both = nodes.join(found.rows().withColumn("cyclic", F.lit(True)), "node", "left").join(own, "node", "left")
    return both.select("node", F.coalesce("component", "node").alias("component"), (F.col("cyclic").isNotNull() | F.col("loops").isNotNull()).alias("on_cycle"))


def discharge_assumptions(assumptions: DataFrame, witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residual assumptions of each claim, and provenance edges.

    ``assumptions(claim, proposition)``; ``witnesses(proposition, needs)`` replaces a proposition by what its
    witness assumes (``needs`` null if nothing).  Each proposition of a claim expands once, so cycles end.
    """
    first, replaced = assumptions.select("claim", "proposition").distinct(), witnesses.select("proposition", "needs").distinct()
    known = Parts(first.sparkSession, "assumed", first.schema)
    provenance = Parts(first.sparkSession, "provenance", first.withColumn("needs", F.lit(None).cast(replaced.schema["needs"].dataType)).schema)
    frontier = known.add(first)
    while not frontier.isEmpty():
        step = provenance.add(frontier.join(replaced, "proposition"))
        onward = step.filter("needs is not null").select("claim", F.col("needs").alias("proposition")).distinct()
        frontier = known.add(onward.join(known.rows(), ["claim", "proposition"], "left_anti"))
    residual = known.rows().join(replaced.select("proposition").distinct(), "proposition", "left_anti")
    return residual.select("claim", "proposition"), provenance.rows()


def lifecycle_usability(keys: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """``key, usability``: one state only, else a conflict; expired and withdrawn refuse, superseded warns, none is absent."""
    states = lifecycle.groupBy("key").agg(F.countDistinct("state").alias("n"), F.min("state").alias("state"))
    both = keys.join(states, "key", "left")
    use = F.when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "conflict").when(F.col("state").isin("expired", "withdrawn"), "refused").when(F.col("state") == "superseded", "warned").otherwise("usable")
    return both.select("key", use.alias("usability"))


def gate_readiness(bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """``gate_id, ready, n_open``: ready when each of ``bindings(gate_id, input_id)`` has exactly one row of ``evidence(input_id)``."""
    counts = evidence.groupBy("input_id").agg(F.count(F.lit(1)).alias("n"))
    rows = bindings.join(counts, "input_id", "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    return rows.groupBy("gate_id").agg(F.bool_and(one).alias("ready"), F.count_if(~one).alias("n_open"))


def change_classes(receipts: DataFrame, plans: DataFrame, receipt_params: DataFrame, plan_params: DataFrame, receipt_inputs: DataFrame, plan_inputs: DataFrame) -> DataFrame:
    """``step_id, change, detail``: what differs between a receipt and the plan of the same step.

    ``receipts``/``plans(step_id, case_id, capability, invocation, status)``; parameters ``(step_id, name,
    value)``; inputs ``(step_id, slot, evidence_id, sha256)``.
    """
    r = receipts.select("step_id", *[F.col(c).alias(f"r_{c}") for c in ("case_id", "capability", "invocation", "status")])
    both = plans.join(r, "step_id")
    rules: dict[str, Column] = {
        "different_case": F.col("case_id") != F.col("r_case_id"), "capability": F.col("capability") != F.col("r_capability"),
        "invocation": F.col("invocation") != F.col("r_invocation"), "receipt_not_completed": F.col("r_status") != "completed",
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    own = both.select("step_id", F.explode(found).alias("change"), F.lit("").alias("detail"))
    steps = both.select("step_id")
    p = plan_params.select("step_id", "name", F.col("value").alias("new")).join(steps, "step_id", "left_semi")
    q = receipt_params.select("step_id", "name", F.col("value").alias("old")).join(steps, "step_id", "left_semi")
    params = p.join(q, ["step_id", "name"], "full_outer").filter(~F.col("new").eqNullSafe(F.col("old"))).select("step_id", F.lit("parameters").alias("change"), F.col("name").alias("detail"))
    p = plan_inputs.select("step_id", "slot", F.col("evidence_id").alias("new"), F.col("sha256").alias("new_bytes")).join(steps, "step_id", "left_semi")
    q = receipt_inputs.select("step_id", "slot", F.col("evidence_id").alias("old"), F.col("sha256").alias("old_bytes")).join(steps, "step_id", "left_semi")
    slots = p.join(q, ["step_id", "slot"], "full_outer")
    kind = F.when(~F.col("new").eqNullSafe(F.col("old")), "input_binding").when(~F.col("new_bytes").eqNullSafe(F.col("old_bytes")), "input_bytes")
    inputs = slots.select("step_id", kind.alias("change"), F.col("slot").alias("detail")).filter("change is not null")
    return own.unionByName(params).unionByName(inputs)


def bound_plan(steps: DataFrame, reuse: DataFrame, capabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A decision for each step, and each plan's status.

    ``steps(plan_id, step_id, capability_id, selected)``, ``reuse(step_id, decision)`` (reuse or refused),
    ``capabilities(capability_id, available)``.
    """
    rows = steps.join(reuse, "step_id", "left").join(capabilities, "capability_id", "left")
    decision = (
        F.when(~F.col("selected"), "not_executed").when(F.col("decision") == "reuse", "reuse_committed").when(F.col("decision") == "refused", "refused")
        .when(F.coalesce("available", F.lit(False)), "execute").otherwise("blocked")
    )
    decided = rows.select("plan_id", "step_id", decision.alias("decision"))
    rank = F.when(F.col("decision") == "refused", 2).when(F.col("decision") == "blocked", 1).otherwise(0)
    names = F.array(F.lit("ready"), F.lit("blocked"), F.lit("refused"))
    plans = decided.groupBy("plan_id").agg(F.when(F.count_if(F.col("decision") != "not_executed") == 0, "unavailable").otherwise(F.element_at(names, F.max(rank) + 1)).alias("status"))
    return decided, plans
