"""The saved-record views, each over all reports or logs at once: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import sql
from assayer.operators import compare, integrity, lineage, summaries, verdicts
from assayer.plans.history_queries import ASSESSMENTS, MOVES, REV_RUNS, REVISIONS, compare_sql, sides, spark_sql
from assayer.plans.integrity_queries import _written_log
from assayer.plans.registry import query
from assayer.plans.verdict_queries import PER_ATTEMPT, attempts
from assayer.sources import files


@query("""SELECT line, case_id, status, count(*) OVER (PARTITION BY case_id) AS n_of_case FROM f_log WHERE kind IN ('run', 'version', 'stepless')""")
def core_history(v):
    runs = files.split_record_kinds(_written_log(v))["run"].select("line", F.col("case_id").cast("long").alias("case_id"), "status")
    return runs.join(runs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_of_case")), "case_id")


@query(f"""SELECT x.attempt_id, r.requirement_id, r.comparison, status, rule, margin FROM f_requirements r LEFT JOIN ({PER_ATTEMPT}) x ON x.requirement_id = r.requirement_id""")
def core_requirements(v):
    found = attempts(v).select("attempt_id", "requirement_id", "status", "rule", "margin")
    report = compare.requirement_report(v("f_requirements").select("requirement_id", "comparison"), found, v("f_claims").select("requirement_id", "claim_id", "state"))
    return report.select("attempt_id", "requirement_id", "comparison", "status", "rule", "margin")


@query("""SELECT attempt_id, claim_id, state AS code, CASE state WHEN 'quarantined' THEN 'Not admitted' END AS title FROM f_claims WHERE state <> 'admitted'""")
def core_findings(v):
    claims = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct("claim_id", F.col("state").alias("code"))).alias("findings"))
    flat = summaries.report_view(claims, "findings", F.col("item.code") != "admitted")
    catalogue = flat.sparkSession.createDataFrame([("quarantined", "Not admitted")], "code string, title string")
    return integrity.explain_findings(flat, catalogue).select("attempt_id", "claim_id", "code", "title")


@query("""SELECT attempt_id, claim_id AS evidence_id, state FROM f_claims""")
def core_evidence(v):
    claims = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct(F.col("claim_id").alias("evidence_id"), "state")).alias("admissions"))
    return summaries.report_view(claims, "admissions")


@query("""SELECT r.line, r.parent_line, l.is_root, l.is_leaf, r.generation FROM f_runs r JOIN (SELECT line, parent_line IS NULL AS is_root, line NOT IN (SELECT parent_line FROM f_runs WHERE parent_line IS NOT NULL) AS is_leaf FROM f_runs) l ON l.line = r.line""")
def core_constellation(v):
    runs = v("f_runs")
    ends = lineage.roots_and_leaves(runs.select(F.col("line").alias("attempt_id"), F.col("parent_line").alias("parent_id"))).withColumnRenamed("attempt_id", "line")
    return runs.join(ends, "line").select("line", "parent_line", "is_root", "is_leaf", "generation")


@query(f"""WITH s AS (SELECT f.line, x.requirement_id % 40 AS r, min(x.status) AS status FROM ({PER_ATTEMPT}) x JOIN f_runs f USING (attempt_id) GROUP BY f.line, x.requirement_id % 40)
SELECT f.line AS attempt_id, count(*) FILTER (c.status = p.status) AS n_unchanged, count(*) FILTER (c.status <> p.status) AS n_changed FROM f_runs f JOIN s c ON c.line = f.line JOIN s p ON p.line = f.parent_line AND p.r = c.r GROUP BY f.line""")
def core_attempt(v):
    compared = compare.compare_attempts(v("f_runs").select(F.col("line").alias("attempt_id"), F.col("parent_line").alias("parent_id")), sides(v))
    both = compared.filter("transition is not null")
    return both.groupBy("attempt_id").agg(F.count_if(F.col("transition") == "unchanged").alias("n_unchanged"), F.count_if(F.col("transition") != "unchanged").alias("n_changed"))


@query(f"""SELECT case_id, count(*) AS n, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail FROM ({PER_ATTEMPT}) x JOIN (SELECT attempt_id, case_id FROM f_runs) r USING (attempt_id) GROUP BY case_id""")
def core_inspect(v):
    found = attempts(v).join(v("f_runs").select("attempt_id", "case_id"), "attempt_id")
    counts = verdicts.status_histogram(found, ["case_id"])
    return counts.select("case_id", F.expr("n_fail + n_inconclusive + n_not_evaluated + n_pass").alias("n"), "n_pass", "n_fail")


def _reports(v, items: dict):
    """Runs with arrays of what their claims stand for."""
    claims = v("f_claims").groupBy("attempt_id").agg(*[F.collect_list(c).alias(name) for name, c in items.items()])
    return v("f_runs").select("attempt_id", "case_id", "status").join(claims, "attempt_id")


@query("""SELECT attempt_id, case_id, status, CASE WHEN ordinal <= 2 THEN 'document' WHEN ordinal <= 5 THEN 'artifact' ELSE 'supplied_input' END AS kind, claim_id AS id, model FROM f_claims JOIN (SELECT attempt_id, case_id, status FROM f_runs) r USING (attempt_id)""")
def core_artifacts(v):
    item, n = F.struct(F.col("claim_id").alias("id"), "model"), F.col("ordinal")
    return summaries.artifact_records(_reports(v, {"documents": F.when(n <= 2, item), "artifacts": F.when((n > 2) & (n <= 5), item), "supplied_inputs": F.when(n > 5, item)}))


@query("""SELECT attempt_id, case_id, status, step_id, ordinal AS slot, requirement_id AS source FROM f_claims JOIN (SELECT attempt_id, case_id, status FROM f_runs) r USING (attempt_id)""")
def core_workflow(v):
    steps = v("f_claims").groupBy("attempt_id", "step_id").agg(F.collect_list(F.struct(F.col("ordinal").alias("slot"), F.col("requirement_id").alias("source"))).alias("bindings"))
    plans = steps.groupBy("attempt_id").agg(F.collect_list(F.struct("step_id", "bindings")).alias("workflow"))
    return summaries.workflow_view(v("f_runs").select("attempt_id", "case_id", "status").join(plans, "attempt_id"))


@query("""SELECT attempt_id, case_id, status, step_id, CASE WHEN bool_and(state = 'admitted') THEN 'executed' ELSE 'refused' END AS step_state, count(*) AS n_outputs
FROM f_claims JOIN (SELECT attempt_id, case_id, status FROM f_runs) r USING (attempt_id) GROUP BY attempt_id, case_id, status, step_id""")
def core_steps(v):
    good = F.bool_and(F.col("state") == "admitted")
    steps = v("f_claims").groupBy("attempt_id", "step_id").agg(F.when(good, "executed").otherwise("refused").alias("step_state"), F.count(F.lit(1)).alias("n_outputs"))
    done = steps.groupBy("attempt_id").agg(F.collect_list(F.struct("step_id", "step_state", "n_outputs")).alias("steps"))
    return summaries.report_view(v("f_runs").select("attempt_id", "case_id", "status").join(done, "attempt_id"), "steps")


@query(f"""WITH e AS (SELECT revision_id, parent_id, line, 'recorded' AS source FROM ({REVISIONS}) x UNION ALL SELECT attempt_id, parent_id, line, 'derived' FROM ({REV_RUNS}) y WHERE revision_id IS NULL), a AS ({ASSESSMENTS}),
k AS (SELECT parent_id AS revision_id, count(*) AS n FROM e GROUP BY parent_id), m AS (SELECT revision_id, count(*) AS n FROM a GROUP BY revision_id)
SELECT e.*, coalesce(k.n, 0) AS n_children, coalesce(m.n, 0) AS n_assessments, a.line AS assessment_line, a.run_id
FROM e LEFT JOIN k ON k.revision_id = e.revision_id LEFT JOIN m ON m.revision_id = e.revision_id LEFT JOIN a ON a.revision_id = e.revision_id""")
def core_revision(v):
    return summaries.revision_view(*(spark_sql(v, s, "f_runs") for s in (REVISIONS, REV_RUNS, ASSESSMENTS)))


# Runs that an assessment cites or that have no revision; every sixteenth crosses an amendment of its case.
ASSESSED = """SELECT line AS attempt_id, CASE WHEN line % 16 = 1 THEN (SELECT arg_max(x.line, x.line * 3) FROM f_runs x WHERE x.case_id = r.case_id AND x.line % 2 = 0) ELSE parent_line END AS parent_id FROM f_runs r WHERE line % 2 = 0 OR line % 3 <> 0"""


@query(f"SELECT c.*, CASE WHEN attempt_id % 2 = 0 THEN 'recorded' ELSE 'derived' END AS source, attempt_id % 16 = 1 AS crosses_amendment FROM ({compare_sql(f'SELECT * FROM ({ASSESSED}) p WHERE parent_id IS NOT NULL')}) c")
def core_assessment(v):
    line = F.col("line")
    runs = v("f_runs").select(line.alias("attempt_id"), F.col("parent_line").alias("parent_id"), "line", F.when(line % 3 == 0, line).alias("revision_id"))
    assessments = v("f_runs").filter("line % 2 = 0").select(F.col("case_id").alias("revision_id"), (line * 3).alias("line"), line.alias("run_id"))
    amendments = v("f_runs").filter("line % 16 = 1").select(line.alias("attempt_id"), F.col("case_id").alias("superseded_revision"))
    return summaries.assessment_view(assessments, runs, amendments, sides(v))


@query(f"""SELECT name, arg_max(target, line) AS target, max(line) AS line, count(*) AS n_moves, count(*) FILTER (superseded IS DISTINCT FROM previous) AS n_broken
FROM (SELECT *, LAG(target) OVER (PARTITION BY name ORDER BY line) AS previous FROM ({MOVES}) m) x GROUP BY name""")
def core_reference(v):
    return summaries.reference_view(spark_sql(v, MOVES, "f_runs"))


@query("""SELECT code, CASE code WHEN 'quarantined' THEN 'Not admitted' WHEN 'rejected' THEN 'The run was refused' END AS title, code IN ('quarantined', 'rejected') AS explained, count(*) AS n
FROM (SELECT state AS code FROM f_claims WHERE state <> 'admitted' UNION ALL SELECT status FROM f_runs WHERE status <> 'evaluated') f GROUP BY code""")
def core_explain(v):
    found = v("f_claims").filter("state <> 'admitted'").select(F.col("state").alias("code")).unionByName(v("f_runs").filter("status <> 'evaluated'").select(F.col("status").alias("code")))
    catalogue = found.sparkSession.createDataFrame([("quarantined", "Not admitted"), ("rejected", "The run was refused")], "code string, title string")
    counted = found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return integrity.explain_findings(counted, catalogue).select("code", "title", "explained", "n")


@query("""SELECT event_id, '' AS pointer, 'object' AS type FROM events UNION ALL SELECT event_id, '/k', 'integer' FROM events""")
def m_flatten_json_lateral(v):
    events = v("events").select("event_id", "props")
    sql.register(events.sparkSession)
    return events.sparkSession.sql("SELECT e.event_id, f.pointer, f.type FROM {events} e, LATERAL flatten_json(e.props) f", events=events)


@query("""SELECT event_id, '/k' AS pointer, 'replaced' AS change FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 5 UNION ALL SELECT event_id, '/x', 'added' FROM events""")
def m_diff_states_lateral(v):
    events = v("events").select("event_id", "props").withColumn("after", F.lit('{"k": 5, "x": [1]}'))
    sql.register(events.sparkSession)
    return events.sparkSession.sql("SELECT e.event_id, d.pointer, d.change FROM {events} e, LATERAL diff_states(e.props, e.after) d", events=events)


#: Every line's numbers by the SQL names of exact, interval and three-valued functions.
NAMED = """SELECT l_orderkey, l_linenumber, lower_decimal(spelled) AS canonical, number_problem(concat('+', spelled)) AS problem, x.num AS sum_num, x.den AS sum_den, y.num AS quotient_num, y.den AS quotient_den,
 exact_cmp(a, b) AS cmp, i.lower AS lower, i.upper AS upper, j.lower AS product_lower, kleene_and(p, q) AS both, kleene_or(p, kleene_not(q)) AS either, content_identity(canonical_json(doc)) AS identity
FROM (SELECT *, exact_add(a, b) AS x, exact_div(a, b) AS y, interval_sub(u, w) AS i, interval_mul(u, w, 'area') AS j FROM
 (SELECT l_orderkey, l_linenumber, concat('0', CAST(CAST(l_quantity AS INT) AS STRING), '.', CAST(l_linenumber AS STRING), '0e2') AS spelled,
  decimal_to_rational(lower_decimal(concat(CAST(l_partkey AS STRING), 'e-2'))) AS a, rational(CAST(l_suppkey - 40 AS DECIMAL(38,0)), CAST(l_linenumber AS DECIMAL(38,0))) AS b,
  exact_interval(CAST(-l_linenumber AS DECIMAL(38,0)), CAST(l_partkey AS DECIMAL(38,0)), 'length') AS u, exact_interval(CAST(l_linenumber AS DECIMAL(38,0)), CAST(l_linenumber + 3 AS DECIMAL(38,0)), CASE WHEN l_returnflag = 'A' THEN 'mass' ELSE 'length' END) AS w,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS p, CASE WHEN l_linenumber > 2 THEN l_linenumber > 4 END AS q, concat('{"b": ', CAST(l_partkey AS STRING), ', "a": [true, null]}') AS doc FROM {lines}))"""


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) * 100 + l_linenumber * 10 AS VARCHAR) AS canonical, 'leading_plus' AS problem,
 CASE WHEN den = k THEN l_partkey / div + s ELSE l_partkey / div * k + s * den END AS sum_num, CASE WHEN den = k THEN den ELSE den * k END AS sum_den,
 CASE WHEN s <> 0 THEN l_partkey / div * k * sign(s) END AS quotient_num, CASE WHEN s <> 0 THEN den * abs(s) END AS quotient_den, CAST(sign(l_partkey * k - s * 100) AS INTEGER) AS cmp,
 CASE WHEN l_returnflag <> 'A' THEN -2 * k - 3 END AS lower, CASE WHEN l_returnflag <> 'A' THEN l_partkey - k END AS upper, -k * (k + 3) AS product_lower, p AND q AS both, p OR NOT q AS either,
 'sha256:' || sha256('{"a":[true,null],"b":' || CAST(l_partkey AS VARCHAR) || '}') AS identity
FROM (SELECT *, CASE WHEN l_partkey % 100 = 0 THEN 1 WHEN l_partkey % 10 = 0 THEN 10 ELSE 100 END AS den, CAST(100 / CASE WHEN l_partkey % 100 = 0 THEN 1 WHEN l_partkey % 10 = 0 THEN 10 ELSE 100 END AS BIGINT) AS div, l_suppkey - 40 AS s, CAST(l_linenumber AS BIGINT) AS k,
 CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS p, CASE WHEN l_linenumber > 2 THEN l_linenumber > 4 END AS q FROM lineitem) x""".replace("l_partkey / div", "l_partkey // div"))
def m_exact_functions(v):
    lines = v("lineitem")
    sql.register(lines.sparkSession)
    found = lines.sparkSession.sql(NAMED.replace("{", "{{").replace("}", "}}").replace("{{lines}}", "{lines}"), lines=lines)
    whole = ["sum_num", "sum_den", "quotient_num", "quotient_den", "lower", "upper", "product_lower"]
    return found.withColumns({c: F.col(c).cast("long") for c in whole})
