"""Queries over dependency graphs, plans and change impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import graph
from assayer.plans.history_queries import spark_sql
from assayer.plans.registry import query

EXEMPT = "SELECT src_step, dst_step, dst_slot FROM f_edges WHERE dst_step % 7 = 0 AND dst_slot = 'b'"
IMPACT = f"""WITH RECURSIVE live AS (SELECT src_step, dst_step, dst_slot FROM f_edges EXCEPT {EXEMPT}), r(step_id) AS (SELECT p_partkey FROM part WHERE p_partkey % 37 = 5 UNION SELECT live.dst_step FROM r JOIN live ON live.src_step = r.step_id)"""


def impact(v):
    changed = v("part").filter("p_partkey % 37 = 5").select(F.col("p_partkey").alias("step_id"))
    return graph.impact_propagation(v("f_edges"), changed, spark_sql(v, EXEMPT, "f_edges"))


@query(f"{IMPACT} SELECT r.step_id, count(live.src_step) AS n_condemning FROM r LEFT JOIN (SELECT * FROM live WHERE src_step IN (SELECT step_id FROM r)) live ON live.dst_step = r.step_id GROUP BY r.step_id")
def i8_impact_propagation(v):
    hit, condemning = impact(v)
    counts = condemning.groupBy(F.col("dst_step").alias("step_id")).agg(F.count(F.lit(1)).alias("n"))
    return hit.join(counts, "step_id", "left").select("step_id", F.coalesce("n", F.lit(0)).alias("n_condemning"))


@query(f"""{IMPACT} SELECT count(*) FILTER (r.step_id IS NOT NULL) AS n_run, count(*) FILTER (r.step_id IS NULL) AS n_reuse,
CASE WHEN count(*) FILTER (r.step_id IS NOT NULL AND p_size > 48) = 0 THEN CAST(coalesce(sum(p_size * 10) FILTER (r.step_id IS NOT NULL), 0) AS BIGINT) END AS duration_ms, count(*) FILTER (r.step_id IS NOT NULL AND p_size > 48) AS n_without_estimate
FROM part LEFT JOIN r ON r.step_id = p_partkey""")
def i9_rerun_subgraph(v):
    steps = v("part").select(F.col("p_partkey").alias("step_id"))
    durations = v("part").filter("p_size <= 48").select(F.col("p_partkey").alias("step_id"), (F.col("p_size") * 10).cast("long").alias("duration_ms"))
    return graph.rerun_subgraph(steps, impact(v)[0], durations)


@query("""WITH RECURSIVE r(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 101 = 3 UNION SELECT f_edges.src_step FROM r JOIN f_edges ON f_edges.dst_step = r.node) SELECT node FROM r""")
def i10_reachable_from_goals(v):
    goals = v("part").filter("p_partkey % 101 = 3").select(F.col("p_partkey").alias("node"))
    return graph.reach(v("f_edges").select(F.col("dst_step").alias("src"), F.col("src_step").alias("dst")), goals)


# Two cycles are added below part 9 and part 20.
CYCLED = "SELECT src_step AS src, dst_step AS dst FROM f_edges UNION SELECT p_partkey, CAST(FLOOR(p_partkey / 2) AS BIGINT) FROM part WHERE p_partkey IN (19, 41)"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({CYCLED}) c), cyc(a, b) AS (SELECT src, dst FROM e WHERE src IN (9, 19, 20, 41) UNION SELECT cyc.a, e.dst FROM cyc JOIN e ON e.src = cyc.b),
bad AS (SELECT 9 AS node UNION SELECT 19 UNION SELECT 20 UNION SELECT 41 UNION SELECT b FROM cyc),
lv(node, level) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM lv JOIN e ON e.src = lv.node WHERE e.dst NOT IN (SELECT node FROM bad))
SELECT node, CAST(max(level) AS INTEGER) AS level FROM lv WHERE node NOT IN (SELECT node FROM bad) GROUP BY node UNION ALL SELECT DISTINCT node, -1 FROM bad""")
def i11_topological_levels(v):
    levels, cyclic = graph.topological_levels(spark_sql(v, CYCLED, "f_edges", "part"))
    return levels.unionByName(cyclic.withColumn("level", F.lit(-1)))


# Every part leads to its two multiples; some lead back to a part above, some to themselves, so that cycles of several
# sizes, nodes below them and nodes above them all occur.
LOOPED = """SELECT CAST(FLOOR(p_partkey / 2) AS BIGINT) AS src, p_partkey AS dst FROM part WHERE p_partkey > 1
 UNION SELECT p_partkey, CAST(FLOOR(p_partkey / 8) AS BIGINT) FROM part WHERE p_partkey % 5 = 0 AND p_partkey >= 160 AND FLOOR(p_partkey / 8) % 7 < 4
 UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 97 = 0"""


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({LOOPED}) l), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT x.a AS node, min(x.b) AS least FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT n.node, coalesce(least, n.node) AS component, least IS NOT NULL AS on_cycle FROM n LEFT JOIN m ON m.node = n.node""")
def i11_detect_cycles(v):
    return graph.detect_cycles(spark_sql(v, LOOPED, "part"))


I12_ASSUME = "SELECT DISTINCT l_orderkey AS claim, CAST(l_partkey % 60 AS VARCHAR(9)) AS proposition FROM lineitem"
I12_WITNESS = "SELECT CAST(k AS VARCHAR(9)) AS proposition, CASE WHEN k % 10 <> 0 THEN CAST((k * 7 + 3) % 60 AS VARCHAR(9)) END AS needs FROM (SELECT DISTINCT p_size AS k FROM part WHERE p_size % 4 <> 1) t UNION SELECT CAST(k AS VARCHAR(9)), CAST((k + 11) % 60 AS VARCHAR(9)) FROM (SELECT DISTINCT p_size AS k FROM part WHERE p_size % 4 = 2) u"


@query(f"""WITH RECURSIVE w AS ({I12_WITNESS}), a(claim, proposition) AS ({I12_ASSUME} UNION SELECT a.claim, w.needs FROM a JOIN w ON w.proposition = a.proposition WHERE w.needs IS NOT NULL)
SELECT claim, proposition FROM a WHERE proposition NOT IN (SELECT proposition FROM w)""")
def i12_discharge_assumptions(v):
    return graph.discharge_assumptions(spark_sql(v, I12_ASSUME, "lineitem"), spark_sql(v, I12_WITNESS, "part"))[0]


@query("""SELECT c_custkey AS key, CASE WHEN n IS NULL THEN 'absent' WHEN n > 1 THEN 'conflict' WHEN s IN ('F', 'P') THEN 'refused' ELSE 'warned' END AS usability FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS s FROM orders WHERE o_orderkey % 8 = 0 GROUP BY o_custkey) t ON o_custkey = c_custkey""")
def i13_lifecycle_usability(v):
    state = F.when(F.col("o_orderstatus") == "F", "expired").when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("superseded")
    return graph.lifecycle_usability(v("customer").select(F.col("c_custkey").alias("key")), v("orders").filter("o_orderkey % 8 = 0").select(F.col("o_custkey").alias("key"), state.alias("state")))


@query("""SELECT o_custkey AS gate_id, bool_and(coalesce(n = 1, false)) AS ready, count(*) FILTER (NOT coalesce(n = 1, false)) AS n_open FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 35 GROUP BY l_orderkey) t ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def j18_gate_readiness(v):
    return graph.gate_readiness(v("orders").select(F.col("o_custkey").alias("gate_id"), F.col("o_orderkey").alias("input_id")), v("lineitem").filter("l_quantity > 35").select(F.col("l_orderkey").alias("input_id")))


@query("""WITH s AS (SELECT o_orderkey AS step_id, o_orderkey % 11 = 0 AS a, o_orderkey % 13 = 0 AS b, o_orderkey % 17 = 0 AS c, o_orderstatus = 'P' AS d FROM orders WHERE o_orderkey % 3 <> 0),
l AS (SELECT DISTINCT l_orderkey AS step_id, l_linenumber AS k FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))
SELECT step_id, 'different_case' AS change, '' AS detail FROM s WHERE a UNION ALL SELECT step_id, 'capability', '' FROM s WHERE b UNION ALL SELECT step_id, 'invocation', '' FROM s WHERE c UNION ALL SELECT step_id, 'receipt_not_completed', '' FROM s WHERE d
UNION ALL SELECT step_id, 'parameters', CAST(k AS VARCHAR) FROM l WHERE (step_id + k) % 19 = 0 OR (k = 3 AND step_id % 2 = 0) UNION ALL SELECT step_id, CASE WHEN (step_id + k) % 23 = 0 THEN 'input_binding' ELSE 'input_bytes' END, CAST(k AS VARCHAR) FROM l WHERE (step_id + k) % 23 = 0 OR (step_id + k) % 29 = 0""")
def j9_change_classes(v):
    k = F.col("o_orderkey")
    row = lambda spoil: v("orders").select(
        k.alias("step_id"), F.when(F.lit(spoil) & (k % 11 == 0), 1).otherwise(0).alias("case_id"), F.when(F.lit(spoil) & (k % 13 == 0), 1).otherwise(0).alias("capability"),
        F.when(F.lit(spoil) & (k % 17 == 0), 1).otherwise(0).alias("invocation"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"))
    n, s = F.col("l_linenumber"), F.col("l_orderkey")
    lines = v("lineitem").select("l_orderkey", "l_linenumber").distinct()
    params = lambda spoil: lines.select(s.alias("step_id"), n.cast("string").alias("name"), F.when(F.lit(spoil) & ((s + n) % 19 == 0), -1).otherwise(n).alias("value"))
    inputs = lambda spoil: lines.select(s.alias("step_id"), n.cast("string").alias("slot"), F.when(F.lit(spoil) & ((s + n) % 23 == 0), -1).otherwise(0).alias("evidence_id"), F.when(F.lit(spoil) & ((s + n) % 29 == 0), -1).otherwise(0).alias("sha256"))
    fewer = params(True).filter("not (name = '3' and step_id % 2 = 0)")
    return graph.change_classes(row(True).filter("step_id % 3 <> 0"), row(False), fewer, params(False), inputs(True), inputs(False))


BOUND = """SELECT o_custkey AS plan_id, o_orderkey AS step_id, CASE WHEN o_orderkey % 5 = 0 THEN 'not_executed' WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'reuse_committed' ELSE 'refused' END WHEN o_custkey % 25 < 20 THEN 'execute' ELSE 'blocked' END AS decision FROM orders"""


def _bound(v):
    steps = v("orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("step_id"), (F.col("o_custkey") % 25).alias("capability_id"), (F.col("o_orderkey") % 5 != 0).alias("selected"))
    reuse = v("orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("step_id"), F.when(F.col("o_orderkey") % 2 == 0, "reuse").otherwise("refused").alias("decision"))
    return graph.bound_plan(steps, reuse, v("nation").select(F.col("n_nationkey").cast("long").alias("capability_id"), (F.col("n_nationkey") < 20).alias("available")))


@query(BOUND)
def j10_bound_plan(v):
    return _bound(v)[0]


@query(f"SELECT plan_id, CASE WHEN count(*) FILTER (decision <> 'not_executed') = 0 THEN 'unavailable' WHEN bool_or(decision = 'refused') THEN 'refused' WHEN bool_or(decision = 'blocked') THEN 'blocked' ELSE 'ready' END AS status FROM ({BOUND}) b GROUP BY plan_id")
def j10_plan_status(v):
    return _bound(v)[1]
