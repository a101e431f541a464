"""Queries over run logs: lineage, comparison, references, transitions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import compare, lineage, search, summaries, transitions
from assayer.plans.registry import query
from assayer.plans.verdict_queries import PER_ATTEMPT, attempts
from assayer.storage import materialize

# Runs with what lineage rules look at; some rows are spoiled, each in one way.
LINES = """SELECT line, 'run-' || CAST(line AS VARCHAR(20)) AS attempt_id, CASE WHEN line % 101 = 7 THEN 'run-0' WHEN parent_line IS NOT NULL THEN 'run-' || CAST(CASE WHEN line % 103 = 5 THEN line + 1 ELSE parent_line END AS VARCHAR(20)) END AS parent_id,
 generation + CASE WHEN line % 97 = 0 THEN 1 ELSE 0 END AS generation, line * 7 AS record_sha256, CASE WHEN parent_line IS NOT NULL THEN CASE WHEN line % 89 = 0 THEN 1 ELSE parent_line * 7 END END AS parent_sha256,
 CASE WHEN line % 83 = 0 THEN 2 ELSE 1 END AS case_id, 1 AS input_id, line % 5 AS state_sha256, CASE WHEN line % 79 = 0 THEN 9 ELSE line % 5 END AS derived_sha256,
 CASE WHEN parent_line IS NULL THEN 0 ELSE 2 END AS n_changes, CASE WHEN line % 73 = 0 THEN 3 ELSE CASE WHEN parent_line IS NULL THEN 0 ELSE 2 END END AS n_derived_changes FROM f_runs"""


def spark_sql(v, sql: str, *names: str):
    """Run SQL over the named views."""
    import re

    frames = {n: v(n) for n in names}
    spark = next(iter(frames.values())).sparkSession
    for n in names:
        sql = re.sub(rf"\b{n}\b", "{" + n + "}", sql)
    return spark.sql(sql, **frames)


def lines(v):
    return spark_sql(v, LINES, "f_runs")


I1_RULES = {
    "root_generation": "parent_id IS NULL AND generation <> 0", "root_changes": "parent_id IS NULL AND n_changes > 0", "parent_missing": "parent_id IS NOT NULL AND p_line IS NULL",
    "parent_not_earlier": "p_line >= line", "generation_step": "generation <> p_generation + 1", "parent_digest": "p_line IS NOT NULL AND parent_sha256 IS DISTINCT FROM p_record",
    "fixed_identity": "case_id <> p_case", "recorded_changes": "p_line IS NOT NULL AND n_changes <> n_derived_changes", "state_digest": "state_sha256 IS DISTINCT FROM derived_sha256",
}


@query(f"WITH r AS ({LINES}), b AS (SELECT r.*, p.line AS p_line, p.generation AS p_generation, p.record_sha256 AS p_record, p.case_id AS p_case FROM r LEFT JOIN r p ON r.parent_id = p.attempt_id) "
       + " UNION ALL ".join(f"SELECT line, '{k}' AS problem FROM b WHERE {c}" for k, c in I1_RULES.items()))
def i1_validate_lineage(v):
    return lineage.validate_lineage(lines(v))


@query(f"WITH r AS ({LINES}) SELECT attempt_id, parent_id IS NULL AS is_root, attempt_id NOT IN (SELECT parent_id FROM r WHERE parent_id IS NOT NULL) AS is_leaf FROM r")
def i2_roots_and_leaves(v):
    return lineage.roots_and_leaves(lines(v))


@query("""WITH RECURSIVE a(node, ancestor, depth) AS (SELECT line, parent_line, 1 FROM f_runs WHERE parent_line IS NOT NULL
UNION ALL SELECT a.node, r.parent_line, a.depth + 1 FROM a JOIN f_runs r ON r.line = a.ancestor WHERE r.parent_line IS NOT NULL) SELECT node, ancestor, CAST(depth AS INTEGER) AS depth FROM a""")
def i3_ancestors(v):
    return lineage.ancestors(v("f_runs"), "line", "parent_line")


REVISIONS = "SELECT 'rev-' || CAST(line AS VARCHAR(20)) AS revision_id, CASE WHEN parent_line % 3 = 0 THEN 'rev-' || CAST(parent_line AS VARCHAR(20)) WHEN parent_line IS NOT NULL THEN 'run-' || CAST(parent_line AS VARCHAR(20)) END AS parent_id, line FROM f_runs WHERE line % 3 = 0"
REV_RUNS = "SELECT 'run-' || CAST(line AS VARCHAR(20)) AS attempt_id, CASE WHEN parent_line % 3 = 0 THEN 'rev-' || CAST(parent_line AS VARCHAR(20)) WHEN parent_line IS NOT NULL THEN 'run-' || CAST(parent_line AS VARCHAR(20)) END AS parent_id, line, CASE WHEN line % 3 = 0 THEN 'rev-' || CAST(line AS VARCHAR(20)) END AS revision_id FROM f_runs"
ASSESSMENTS = "SELECT CASE WHEN line % 3 = 0 THEN 'rev-' ELSE 'run-' END || CAST(line AS VARCHAR(20)) AS revision_id, line + 1 AS line, 'run-' || CAST(line AS VARCHAR(20)) AS run_id FROM f_runs WHERE line % 2 = 0"


@query(f"""WITH e AS (SELECT revision_id, parent_id, line, true AS recorded FROM ({REVISIONS}) x UNION ALL SELECT attempt_id, parent_id, line, false FROM ({REV_RUNS}) y WHERE revision_id IS NULL)
SELECT e.*, (SELECT count(*) FROM e c WHERE c.parent_id = e.revision_id) AS n_children, (SELECT count(*) FROM ({ASSESSMENTS}) a WHERE a.revision_id = e.revision_id) AS n_assessments,
(SELECT max(line) FROM ({ASSESSMENTS}) a WHERE a.revision_id = e.revision_id) AS last_assessment FROM e""")
def i4_resolve_revisions(v):
    return lineage.resolve_revisions(*(spark_sql(v, s, "f_runs") for s in (REVISIONS, REV_RUNS, ASSESSMENTS)))


I5 = "SELECT line, 'rev-' || CAST(line AS VARCHAR(20)) AS revision_id, CASE WHEN line % 59 = 0 THEN 'rev-0' WHEN line % 61 = 0 THEN 'rev-' || CAST(line AS VARCHAR(20)) WHEN parent_line IS NOT NULL THEN 'rev-' || CAST(parent_line AS VARCHAR(20)) END AS parent_id, generation + CASE WHEN line % 53 = 0 THEN 1 ELSE 0 END AS generation, line % 47 = 0 AS case_id, CASE WHEN line % 43 = 0 THEN line * 2 WHEN line = 1 THEN 4 END AS amendment_id FROM f_runs"
I5_RULES = {
    "root_generation": "parent_id IS NULL AND generation <> 0", "parent_missing": "parent_id IS NOT NULL AND p_line IS NULL", "parent_not_earlier": "p_line >= line", "generation_step": "generation <> p_generation + 1",
    "fixed_identity": "case_id <> p_case", "amendment_on_child": "parent_id IS NOT NULL AND amendment_id IS NOT NULL", "amendment_missing": "amendment_id IS NOT NULL AND a_line IS NULL", "amendment_not_earlier": "a_line >= line", "id_is_a_run": "line % 67 = 0",
}


@query(f"WITH r AS ({I5}), b AS (SELECT r.*, p.line AS p_line, p.generation AS p_generation, p.case_id AS p_case, a.line AS a_line FROM r LEFT JOIN r p ON r.parent_id = p.revision_id LEFT JOIN (SELECT line * 2 AS amendment_id, line - 1 AS line FROM f_runs WHERE line % 86 <> 0) a ON a.amendment_id = r.amendment_id) "
       + " UNION ALL ".join(f"SELECT line, '{k}' AS problem FROM b WHERE {c}" for k, c in I5_RULES.items()))
def i5_validate_revisions(v):
    runs = v("f_runs").filter("line % 67 = 0").select(F.concat(F.lit("rev-"), "line").alias("attempt_id"))
    amendments = v("f_runs").filter("line % 86 <> 0").select((F.col("line") * 2).alias("amendment_id"), (F.col("line") - 1).alias("line"))
    return lineage.validate_revisions(spark_sql(v, I5, "f_runs"), runs, amendments)


I6 = "SELECT line + CASE WHEN line % 31 = 0 THEN -3 ELSE 1 END AS line, CASE WHEN line % 37 = 0 THEN -line ELSE line END AS run_id, line * 7 + CASE WHEN line % 41 = 0 THEN 1 ELSE 0 END AS run_sha256, CASE WHEN line % 29 = 0 THEN 0 ELSE line % 11 END AS revision_id, status || CASE WHEN line % 23 = 0 THEN '!' ELSE '' END AS verdicts FROM f_runs"


@query(f"WITH a AS ({I6}), b AS (SELECT a.*, r.line AS r_line, r.line * 7 AS r_sha, r.line % 11 AS r_rev, r.status AS r_verdicts FROM a LEFT JOIN f_runs r ON r.line = a.run_id) "
       + " UNION ALL ".join(f"SELECT line, '{k}' AS problem FROM b WHERE {c}" for k, c in {"run_missing": "r_line IS NULL", "run_not_earlier": "r_line >= line", "run_digest": "r_sha <> run_sha256", "revision": "r_rev <> revision_id", "verdicts_not_verbatim": "r_verdicts <> verdicts"}.items()))
def i6_validate_assessments(v):
    runs = v("f_runs").select("line", F.col("line").alias("attempt_id"), (F.col("line") * 7).alias("record_sha256"), (F.col("line") % 11).alias("revision_id"), F.col("status").alias("verdicts"))
    return lineage.validate_assessments(spark_sql(v, I6, "f_runs"), runs)


I7 = "SELECT line, CASE WHEN line % 7 = 0 THEN line + 1 WHEN line % 11 = 0 THEN -1 ELSE 1 + (line % 2) END AS superseded, line % 13 = 0 AS case_id, CASE WHEN line % 17 = 0 THEN ' ' ELSE 'a' END AS actor, CASE WHEN line % 19 = 0 THEN NULL ELSE 'r' END AS rationale FROM f_runs WHERE line > 2"


@query(f"WITH a AS ({I7}), b AS (SELECT a.*, r.line AS t_line, r.parent_line FROM a LEFT JOIN f_runs r ON r.line = a.superseded) "
       + " UNION ALL ".join(f"SELECT line, '{k}' AS problem FROM b WHERE {c}" for k, c in {"target_missing": "t_line IS NULL", "target_not_earlier": "t_line >= line", "target_not_root": "parent_line IS NOT NULL", "identity": "t_line IS NOT NULL AND case_id", "actor_empty": "trim(actor) = ''", "rationale_empty": "rationale IS NULL"}.items()))
def i7_validate_amendments(v):
    revisions = v("f_runs").select(F.col("line").alias("revision_id"), "line", F.col("parent_line").alias("parent_id"), F.lit(False).alias("case_id"))
    return lineage.validate_amendments(spark_sql(v, I7, "f_runs"), revisions)


SIDE = f"SELECT line AS attempt_id, parent_line AS parent_id, requirement_id, status, margin, unit, lim, false AS categorical FROM (SELECT f_runs.line, f_runs.parent_line, x.requirement_id % 40 AS requirement_id, min(x.status) AS status, min(x.margin) AS margin, CASE WHEN min(x.requirement_id) % 9 = 0 THEN 'usd' ELSE 'cent' END AS unit, min(x.requirement_id % 2) AS lim FROM ({PER_ATTEMPT}) x JOIN f_runs USING (attempt_id) GROUP BY f_runs.line, f_runs.parent_line, x.requirement_id % 40) s"


def sides(v):
    """Verdict sets of runs by line, over forty requirements so that runs share some."""
    found = attempts(v).join(v("f_runs").select("attempt_id", "line"), "attempt_id").withColumn("r", F.col("requirement_id") % 40)
    grouped = found.groupBy("line", "r").agg(F.min("status").alias("status"), F.min("margin").alias("margin"), F.min("requirement_id").alias("low"), F.min(F.col("requirement_id") % 2).alias("limit"))
    found = grouped.select(F.col("line").alias("attempt_id"), F.col("r").alias("requirement_id"), "status", "margin", F.when(F.col("low") % 9 == 0, "usd").otherwise("cent").alias("unit"), "limit", F.lit(False).alias("categorical"))
    return materialize(found, "sides")  # both sides of a comparison read it


def compare_sql(pairs: str) -> str:
    return f"""WITH s AS ({SIDE}), pr AS ({pairs}), k AS (SELECT pr.attempt_id, pr.parent_id, requirement_id FROM pr JOIN s USING (attempt_id) UNION SELECT pr.attempt_id, pr.parent_id, s.requirement_id FROM pr JOIN s ON s.attempt_id = pr.parent_id)
SELECT k.attempt_id, k.parent_id, k.requirement_id, p.status AS parent_status, c.status AS child_status,
CASE WHEN p.status <> c.status THEN p.status || '>' || c.status WHEN p.status = c.status THEN 'unchanged' END AS transition,
CASE WHEN p.margin IS NOT NULL AND c.margin IS NOT NULL AND p.unit = c.unit AND p.lim = c.lim THEN c.margin - p.margin END AS delta,
CASE WHEN c.status IS NULL THEN 'child_missing' WHEN p.status IS NULL THEN 'parent_missing' WHEN p.margin IS NULL AND c.margin IS NULL THEN 'both_missing' WHEN p.margin IS NULL THEN 'parent_missing' WHEN c.margin IS NULL THEN 'child_missing'
WHEN p.unit <> c.unit THEN 'unit_mismatch' WHEN p.lim <> c.lim THEN 'limit_mismatch' END AS unavailable
FROM k LEFT JOIN s c ON c.attempt_id = k.attempt_id AND c.requirement_id = k.requirement_id LEFT JOIN s p ON p.attempt_id = k.parent_id AND p.requirement_id = k.requirement_id"""


@query(compare_sql("SELECT line AS attempt_id, line - 1 AS parent_id FROM f_runs WHERE line > 1"))
def c7_compare_verdict_sets(v):
    pairs = v("f_runs").filter("line > 1").select(F.col("line").alias("attempt_id"), (F.col("line") - 1).alias("parent_id"))
    found = sides(v)
    return compare.compare_verdict_sets(pairs.join(found.withColumnRenamed("attempt_id", "parent_id"), "parent_id"), pairs.join(found, "attempt_id"), ["attempt_id", "parent_id"])


@query(compare_sql("SELECT line AS attempt_id, parent_line AS parent_id FROM f_runs WHERE parent_line IS NOT NULL"))
def c8_compare_attempts(v):
    return compare.compare_attempts(v("f_runs").select(F.col("line").alias("attempt_id"), F.col("parent_line").alias("parent_id")), sides(v))


@query(compare_sql("SELECT line AS attempt_id, (SELECT arg_max(a.line, a.line * 3) FROM f_runs a WHERE a.case_id = r.case_id) AS parent_id FROM f_runs r"))
def c9_cross_amendment_compare(v):
    runs = v("f_runs")
    amendments = runs.select(F.col("line").alias("attempt_id"), F.col("case_id").alias("superseded_revision"))
    assessments = runs.select(F.col("case_id").alias("revision_id"), (F.col("line") * 3).alias("line"), F.col("line").alias("run_id"))
    return compare.cross_amendment_compare(amendments, assessments, sides(v))


@query("""WITH t AS (SELECT CASE WHEN line % 5 = 0 THEN -1 - line ELSE line END AS id, min(line) AS line FROM f_runs GROUP BY 1)
SELECT r.line, r.ref, CASE WHEN t.line IS NULL THEN 'missing' ELSE 'not_earlier' END AS problem FROM (SELECT line, CASE WHEN line % 7 = 0 THEN line + 3 ELSE parent_line END AS ref FROM f_runs) r LEFT JOIN t ON t.id = r.ref WHERE t.line IS NULL OR t.line >= r.line""")
def c10_precedes_check(v):
    runs = v("f_runs")
    return compare.precedes_check(runs.selectExpr("CASE WHEN line % 5 = 0 THEN -1 - line ELSE line END AS id", "line"), runs.select("line", F.expr("CASE WHEN line % 7 = 0 THEN line + 3 ELSE parent_line END").alias("ref")))


@query(f"""WITH d AS (SELECT CASE WHEN requirement_id % 3 = 0 THEN -1 - requirement_id ELSE requirement_id END AS requirement_id, comparison AS c FROM f_requirements), x AS (SELECT attempt_id, requirement_id, status, margin FROM ({PER_ATTEMPT}) p),
a AS (SELECT requirement_id, count(*) FILTER (state = 'admitted') AS n_admitted, count(*) FILTER (state <> 'admitted') AS n_not_admitted FROM f_claims GROUP BY requirement_id)
SELECT attempt_id, coalesce(d.requirement_id, x.requirement_id) AS requirement_id, c, d.requirement_id IS NOT NULL AS defined, status, margin, coalesce(n_admitted, 0) AS n_admitted, coalesce(n_not_admitted, 0) AS n_not_admitted
FROM d FULL JOIN x ON d.requirement_id = x.requirement_id LEFT JOIN a ON a.requirement_id = coalesce(d.requirement_id, x.requirement_id)""")
def c3_requirement_report(v):
    found = attempts(v).select("attempt_id", "requirement_id", "status", "margin")
    definitions = v("f_requirements").selectExpr("CASE WHEN requirement_id % 3 = 0 THEN -1 - requirement_id ELSE requirement_id END AS requirement_id", "comparison AS c")
    return compare.requirement_report(definitions, found, v("f_claims").select("requirement_id", "claim_id", "state"))


@query("SELECT claim_id, requirement_id FROM f_claims WHERE requirement_id NOT IN (SELECT requirement_id FROM f_requirements WHERE basis <> 'nominal')")
def c4_missing_references(v):
    return compare.missing_references(v("f_claims").select("claim_id", "requirement_id"), v("f_requirements").filter("basis <> 'nominal'"), "requirement_id")


@query("SELECT case_id, arg_max(line, line) AS line, arg_max(attempt_id, line) AS attempt_id, arg_max(status, line) AS status FROM f_runs GROUP BY case_id")
def e1_latest_per_key(v):
    return lineage.latest_per_key(v("f_runs").select("case_id", "line", "attempt_id", "status"), ["case_id"], ["line"])


MOVES = "SELECT case_id AS name, line, attempt_id AS target, CASE WHEN line % 13 = 0 THEN 0 ELSE LAG(attempt_id) OVER (PARTITION BY case_id ORDER BY line) END AS superseded FROM f_runs"


@query(f"SELECT name, line, target, superseded, previous, superseded IS DISTINCT FROM previous AS broken FROM (SELECT *, LAG(target) OVER (PARTITION BY name ORDER BY line) AS previous FROM ({MOVES}) m) x")
def e2_reference_history(v):
    moves, bad = lineage.reference_history(spark_sql(v, MOVES, "f_runs"))
    return moves.join(bad.withColumn("broken", F.lit(True)), ["name", "line"], "left").withColumn("broken", F.coalesce("broken", F.lit(False)))


FROM_STATE = "SELECT transition_id, subject_kind, subject, at_time, to_state, CASE WHEN transition_id % 17 = 0 THEN 'running' ELSE COALESCE(LAG(to_state) OVER (PARTITION BY subject ORDER BY at_time, transition_id), 'planned') END AS from_state FROM f_transitions"
BEFORE = f"SELECT *, COALESCE(LAG(to_state) OVER (PARTITION BY subject ORDER BY at_time, transition_id), 'planned') AS derived_state FROM ({FROM_STATE}) f"
ORDER = ["at_time", "transition_id"]


@query(f"SELECT transition_id, subject, from_state, derived_state FROM ({BEFORE}) x WHERE from_state <> derived_state")
def e7_transition_continuity(v):
    return transitions.transition_continuity(spark_sql(v, FROM_STATE, "f_transitions"), ORDER).select("transition_id", "subject", "from_state", "derived_state")


@query("SELECT 'campaign' AS subject_kind, subject, list(to_state ORDER BY at_time DESC, transition_id DESC)[1] AS state FROM f_transitions GROUP BY subject")
def e8_derived_state(v):
    return transitions.derived_state(v("f_transitions"), ORDER)


LEGAL = "(VALUES ('planned','running'),('planned','cancelled'),('running','blocked'),('running','completed'),('running','cancelled'),('running','superseded'),('blocked','running'),('blocked','cancelled'),('blocked','superseded'),('completed','invalidated')) AS l(f, t)"


@query(f"""WITH b AS ({BEFORE}), j AS (SELECT b.*, l.f IS NOT NULL AS legal FROM b LEFT JOIN {LEGAL} ON l.f = b.from_state AND l.t = b.to_state)
SELECT transition_id, 'discontinuous' AS problem FROM j WHERE from_state <> derived_state UNION ALL SELECT transition_id, 'illegal_move' FROM j WHERE NOT legal
UNION ALL SELECT transition_id, 'attestation_missing' FROM j WHERE transition_id % 29 = 0 UNION ALL SELECT transition_id, 'attestation_digest' FROM j WHERE transition_id % 29 <> 0 AND transition_id % 31 = 0
UNION ALL SELECT transition_id, 'attestation_role' FROM j WHERE transition_id % 29 <> 0 AND transition_id % 37 = 0""")
def j16_check_transitions(v):
    t = spark_sql(v, FROM_STATE, "f_transitions").withColumns({"attestation_id": F.col("transition_id") + 1_000_000, "attestation_sha256": F.col("transition_id") % 1000})
    attested = v("f_transitions").filter("transition_id % 29 <> 0").select(
        (F.col("transition_id") + 1_000_000).alias("attestation_id"), F.when(F.col("transition_id") % 31 == 0, -1).otherwise(F.col("transition_id") % 1000).alias("record_sha256"),
        F.when(F.col("transition_id") % 37 == 0, "runner").otherwise("requester").alias("role"))
    return transitions.check_transitions(t, attested, ORDER)


@query("""SELECT 'run' AS section, status AS name, '' AS detail, count(*) AS n FROM f_runs GROUP BY status
UNION ALL SELECT 'step', to_state, '', count(*) FROM f_transitions GROUP BY to_state
UNION ALL SELECT 'attention', CAST(attempt_id AS VARCHAR), status, 1 FROM f_runs WHERE status <> 'evaluated'
UNION ALL SELECT 'latest', CAST(case_id AS VARCHAR), arg_max(status, line), max(line) FROM f_runs GROUP BY case_id""")
def d10_supervision(v):
    runs = v("f_runs")
    return summaries.supervision(runs, v("f_transitions").select(F.col("to_state").alias("state")))


@query("""SELECT count(*) AS n_runs, count(DISTINCT case_id) AS n_cases, count(*) FILTER (parent_line IS NULL) AS n_roots, count(*) FILTER (line NOT IN (SELECT parent_line FROM f_runs WHERE parent_line IS NOT NULL)) AS n_leaves,
max(generation) AS max_generation, count(DISTINCT status || CAST(case_id AS VARCHAR)) AS n_states FROM f_runs""")
def d11_constellation_summary(v):
    runs = v("f_runs").select(F.col("line").alias("attempt_id"), F.col("parent_line").alias("parent_id"), "case_id", "generation", F.concat("status", F.col("case_id").cast("string")).alias("state_sha256"))
    return summaries.constellation_summary(runs)


@query("SELECT line, attempt_id, status, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 60 THEN 60 END AS next_offset FROM f_runs ORDER BY line LIMIT 20 OFFSET 40")
def b3_page(v):
    return summaries.page(v("f_runs").select("line", "attempt_id", "status"), ["line"], 40, 20)


@query("""SELECT a.attempt_id, n AS n_steps FROM (SELECT attempt_id, count(*) FILTER (requirement_id % 5 = 2) AS n FROM f_claims GROUP BY attempt_id) a JOIN f_runs r USING (attempt_id) WHERE n > 0 AND r.case_id % 2 = 0""")
def b2_search_history(v):
    steps = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct("claim_id", (F.col("requirement_id") % 5).alias("planned_invocation"))).alias("steps"))
    runs = v("f_runs").join(steps, "attempt_id").withColumn("half", F.col("case_id") % 2)
    return summaries.search_history(runs, F.col("half") == 0, 2).select("attempt_id", F.size("steps").cast("long").alias("n_steps"))


@query("""SELECT attempt_id, line, status, count(c.claim_id) AS n_claims, count(c.claim_id) FILTER (c.state <> 'admitted') AS n_findings, count(DISTINCT c.model) AS n_models FROM f_runs LEFT JOIN f_claims c USING (attempt_id) GROUP BY attempt_id, line, status""")
def b1_inspect_reports(v):
    claims = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct("claim_id", "state", "model")).alias("claims"))
    return summaries.inspect_reports(v("f_runs").join(claims, "attempt_id", "left").select("attempt_id", "line", "status", "claims"))


@query("""SELECT attempt_id, r.case_id, r.status, claim_id AS item_id, model AS kind, state FROM f_claims JOIN f_runs r USING (attempt_id) WHERE model = 'interval'""")
def b11_report_view(v):
    claims = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct(F.col("claim_id").alias("item_id"), F.col("model").alias("kind"), "state")).alias("items"))
    return summaries.report_view(v("f_runs").join(claims, "attempt_id").select("attempt_id", "case_id", "status", "items"), "items", F.col("item.kind") == "interval")


PASSES = f"SELECT r.case_id AS arm, r.line, bool_and(x.status = 'pass') AS all_pass, max(x.margin) AS metric, min(x.margin) AS worst FROM ({PER_ATTEMPT}) x JOIN f_runs r USING (attempt_id) GROUP BY r.case_id, r.line"


@query(f"SELECT arm, min(pos) FILTER (all_pass) AS first_pass, count(*) AS n_runs FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY line) AS pos FROM ({PASSES}) p) q GROUP BY arm")
def e3_first_pass_index(v):
    return search.first_pass_index(search.run_outcomes(attempts(v), v("f_runs")), ["arm"])
