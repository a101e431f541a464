"""Queries over verdicts: units, requirements, decision table, aggregation, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import units, verdicts
from assayer.plans.registry import query

REQUIREMENT = ["requirement_id"]
# The decision table once more, in SQL: v has a row per group with the requirement's columns.
GROUPED = """
SELECT {keys}, count(claim_id) AS n_claims, count(DISTINCT {instance}) AS n_instances, count(*) FILTER (claim_id IS NOT NULL AND {instance} IS NULL) AS n_nameless, max(mode) AS mode,
  arg_min(CASE WHEN state <> 'admitted' THEN state END, CASE WHEN state <> 'admitted' THEN ordinal END) AS open_state,
  bool_or(model = 'coverage_interval') AS any_coverage, arg_min(problem, CASE WHEN problem IS NOT NULL THEN ordinal END) AS claim_problem,
  CASE WHEN max(mode) = 'min' THEN CASE WHEN count(lo) = count(claim_id) THEN min(lo) END ELSE max(lo) END AS lower,
  CASE WHEN max(mode) = 'max' THEN CASE WHEN count(hi) = count(claim_id) THEN max(hi) END WHEN max(mode) = 'min' THEN min(hi) ELSE max(hi) END AS upper,
  CASE WHEN max(mode) IS NULL THEN max(nominal_minor) END AS nominal
FROM (SELECT c.*, {mode} AS mode, CASE WHEN model = 'exact' THEN nominal_minor ELSE lower_minor END AS lo, CASE WHEN model = 'exact' THEN nominal_minor ELSE upper_minor END AS hi,
  CASE WHEN NOT coalesce(CASE model WHEN 'exact' THEN nominal_minor IS NOT NULL AND lower_minor IS NULL AND upper_minor IS NULL AND coverage IS NULL
      WHEN 'unquantified' THEN nominal_minor IS NOT NULL AND lower_minor IS NULL AND upper_minor IS NULL AND coverage IS NULL
      WHEN 'interval' THEN lower_minor IS NOT NULL AND upper_minor IS NOT NULL AND coverage IS NULL
      WHEN 'coverage_interval' THEN lower_minor IS NOT NULL AND upper_minor IS NOT NULL AND nominal_minor IS NOT NULL AND coverage IS NOT NULL
      WHEN 'worst_case' THEN (lower_minor IS NOT NULL) <> (upper_minor IS NOT NULL) END, false) THEN 'claim_shape'
    WHEN lower_minor > upper_minor THEN 'lower_above_upper' WHEN nominal_minor < lower_minor OR nominal_minor > upper_minor THEN 'nominal_outside'
    WHEN coverage < required_coverage THEN 'coverage_below_required' END AS problem
  FROM f_claims c JOIN f_requirements USING (requirement_id)) b GROUP BY {keys}"""
DECIDED = """
SELECT *, CASE WHEN rule LIKE 'not_evaluated%' THEN 'not_evaluated' WHEN rule LIKE '%.within' THEN 'pass' WHEN rule LIKE '%.exceeds' OR rule LIKE '%.below' OR rule LIKE '%.outside' THEN 'fail' ELSE 'inconclusive' END AS status
FROM (SELECT *, CASE
    WHEN n_claims = 0 THEN 'not_evaluated.missing' WHEN open_state IS NOT NULL THEN 'not_evaluated.' || open_state
    WHEN n_claims > 1 AND mode IS NULL THEN 'not_evaluated.duplicate_claim'
    WHEN n_claims > 1 AND basis = 'bounded' AND any_coverage THEN 'not_evaluated.coverage_aggregation_requires_capability'
    WHEN claim_problem IS NOT NULL OR (mode IS NOT NULL AND (n_nameless > 0 OR n_instances <> n_claims)) OR (basis = 'nominal' AND (NOT permit_nominal OR nominal IS NULL)) OR (basis <> 'nominal' AND comparison <> 'equal' AND lower IS NULL AND upper IS NULL) THEN 'not_evaluated.kernel_refusal'
    WHEN basis = 'nominal' AND comparison = 'equal' THEN CASE WHEN abs(nominal - limit_minor) <= tolerance_minor THEN 'nominal.equal.within' ELSE 'nominal.equal.outside' END
    WHEN basis = 'nominal' THEN 'nominal.' || token || CASE WHEN sat(nominal, limit_minor, comparison) THEN '.within' WHEN token IN ('gt', 'ge') THEN '.below' ELSE '.exceeds' END
    WHEN comparison = 'equal' THEN CASE WHEN lower >= limit_minor - tolerance_minor AND upper <= limit_minor + tolerance_minor THEN 'equal.within'
      WHEN lower > limit_minor + tolerance_minor OR upper < limit_minor - tolerance_minor THEN 'equal.outside' ELSE 'equal.partial' END
    ELSE basis || '.' || token || '.' || CASE
      WHEN sat(CASE WHEN token IN ('lt', 'le') THEN upper ELSE lower END, limit_minor, comparison) THEN 'within'
      WHEN NOT sat(CASE WHEN token IN ('lt', 'le') THEN lower ELSE upper END, limit_minor, comparison) THEN CASE WHEN token IN ('lt', 'le') THEN 'exceeds' ELSE 'below' END
      WHEN lower IS NOT NULL AND upper IS NOT NULL THEN 'crossing' WHEN upper IS NOT NULL THEN 'upper_only' ELSE 'lower_only' END END AS rule
  FROM (SELECT g.*, comparison, basis, limit_minor, tolerance_minor, permit_nominal,
    CASE comparison WHEN 'less_than' THEN 'lt' WHEN 'less_than_or_equal' THEN 'le' WHEN 'greater_than' THEN 'gt' WHEN 'greater_than_or_equal' THEN 'ge' ELSE 'equal' END AS token
    FROM ({grouped}) g JOIN f_requirements USING (requirement_id)) t) u"""
MARGIN = """CASE WHEN status <> 'not_evaluated' THEN CASE WHEN comparison IN ('less_than', 'less_than_or_equal') THEN limit_minor - CASE WHEN basis = 'nominal' THEN nominal ELSE upper END
  WHEN comparison <> 'equal' THEN CASE WHEN basis = 'nominal' THEN nominal ELSE lower END - limit_minor END END"""


def _inline(sql: str) -> str:
    """Spell out ``sat(value, limit, comparison)``."""
    out, at = "", 0
    while (k := sql.find("sat(", at)) >= 0:
        depth, end = 0, k + 3
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        value = sql[k + 4 : end].removesuffix(", limit_minor, comparison")
        out += sql[at:k] + f"(CASE comparison WHEN 'less_than' THEN ({value}) < limit_minor WHEN 'less_than_or_equal' THEN ({value}) <= limit_minor WHEN 'greater_than' THEN ({value}) > limit_minor ELSE ({value}) >= limit_minor END)"
        at = end + 1
    return out + sql[at:]


def decided_sql(keys: str, mode: str = "CAST(NULL AS VARCHAR)", instance: str = "claim_id") -> str:
    return _inline(DECIDED.format(grouped=GROUPED.format(keys=keys, mode=mode, instance=instance)))


# A nominal verdict states no bounds.
SHOWN = "* REPLACE (CASE WHEN basis <> 'nominal' THEN lower END AS lower, CASE WHEN basis <> 'nominal' THEN upper END AS upper)"
# Some claims name no instance, some share one.
INSTANCE = "CASE WHEN claim_id % 211 = 0 THEN NULL WHEN claim_id % 101 = 0 THEN 101 ELSE claim_id END"
PER_ATTEMPT = f"SELECT {SHOWN}, {MARGIN} AS margin FROM ({decided_sql('attempt_id, requirement_id')}) d"
PER_PART = f"SELECT {SHOWN}, {MARGIN} AS margin FROM ({decided_sql('requirement_id', '''CASE WHEN requirement_id % 2 = 0 THEN 'max' ELSE 'min' END''', INSTANCE)}) d"


def attempts(v):
    """Verdicts of each attempt's claims on each requirement."""
    return verdicts.evaluate_verdicts(v("f_requirements"), v("f_claims"), REQUIREMENT, ["attempt_id"])


@query(f"SELECT attempt_id, requirement_id, n_claims, status, rule, lower, upper, nominal, margin FROM ({PER_ATTEMPT}) x")
def d1_evaluate_verdicts(v):
    return attempts(v).select("attempt_id", "requirement_id", "n_claims", "status", "rule", "lower", "upper", "nominal", "margin")


@query(f"SELECT requirement_id, mode, n_claims, lower, upper, status, rule, margin FROM ({PER_PART}) x")
def d2_reduce_interval(v):
    mode = F.when(F.col("requirement_id") % 2 == 0, "max").otherwise("min")
    claims = v("f_claims").withColumn("instance_id", F.expr(INSTANCE))
    return verdicts.evaluate_verdicts(v("f_requirements"), claims, REQUIREMENT, None, mode).select("requirement_id", "mode", "n_claims", "lower", "upper", "status", "rule", "margin")


RANK = "CASE status WHEN 'fail' THEN {} WHEN 'not_evaluated' THEN 1 WHEN 'inconclusive' THEN 2 ELSE {} END"


@query(f"""SELECT attempt_id, list_extract(['fail', 'not_evaluated', 'inconclusive', 'pass'], 1 + min({RANK.format(0, 3)})) AS all_status,
list_extract(['pass', 'not_evaluated', 'inconclusive', 'fail'], 1 + min({RANK.format(3, 0)})) AS any_status FROM ({PER_ATTEMPT}) x GROUP BY attempt_id""")
def d3_aggregate_verdicts(v):
    found = attempts(v)
    return found.groupBy("attempt_id").agg(*[verdicts.aggregated(mode).alias(f"{mode}_status") for mode in ("all", "any")])


@query(f"""SELECT attempt_id, count(*) AS n, count(*) FILTER (status IN ('pass', 'fail') OR rule IN ('bounded.lt.crossing', 'equal.partial')) AS n_fulfilling,
bool_and(status IN ('pass', 'fail') OR rule IN ('bounded.lt.crossing', 'equal.partial')) AS complete FROM ({PER_ATTEMPT}) x GROUP BY attempt_id""")
def d4_assess_completion(v):
    return verdicts.assess_completion(attempts(v), ["attempt_id"], ["bounded.lt.crossing", "equal.partial"])


@query(f"""SELECT requirement_id, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'inconclusive') AS n_inconclusive,
count(*) FILTER (status = 'not_evaluated') AS n_not_evaluated, count(*) FILTER (status = 'pass') AS n_pass FROM ({PER_ATTEMPT}) x GROUP BY requirement_id""")
def d8_status_histogram(v):
    return verdicts.status_histogram(attempts(v), REQUIREMENT)


@query(f"""SELECT requirement_id, count(*) AS n_binding FROM ({PER_ATTEMPT}) x JOIN (SELECT attempt_id, min(margin) AS worst FROM ({PER_ATTEMPT}) y GROUP BY attempt_id) w USING (attempt_id)
WHERE margin <= worst + 500 GROUP BY requirement_id""")
def d9_binding_counts(v):
    return verdicts.binding_counts(attempts(v), ["attempt_id"], 500)


@query(f"SELECT attempt_id, requirement_id, status, margin, CASE WHEN margin IS NULL THEN 'none' WHEN margin < 0 THEN 'outside' ELSE 'inside' END AS side FROM ({PER_ATTEMPT}) x")
def d21_margins(v):
    side = F.when(F.col("margin").isNull(), "none").when(F.col("margin") < 0, "outside").otherwise("inside")
    return attempts(v).select("attempt_id", "requirement_id", "status", "margin", side.alias("side"))


@query(f"""SELECT attempt_id, m.margin AS worst, m.requirement_id AS binding FROM (
SELECT attempt_id, min({{'margin': margin, 'requirement_id': requirement_id}}) FILTER (margin IS NOT NULL) AS m FROM ({PER_ATTEMPT}) x GROUP BY attempt_id) y""")
def e9_worst_margin(v):
    return verdicts.worst_margin(attempts(v), ["attempt_id"])


@query("""SELECT requirement_id, problem FROM f_requirements, (VALUES ('coverage_needs_bounded_basis'), ('tolerance_without_equality')) AS p(problem)
WHERE CASE problem WHEN 'coverage_needs_bounded_basis' THEN required_coverage IS NOT NULL AND basis <> 'bounded' ELSE comparison <> 'equal' END""")
def b12_check_requirements(v):
    return verdicts.check_requirements(v("f_requirements"))


@query("""SELECT basis, comparison, model, has_lower, has_upper, has_nominal, count(*) AS n,
CASE basis WHEN 'bounded' THEN model IN ('exact', 'interval', 'coverage_interval') OR (model = 'worst_case' AND CASE WHEN comparison = 'equal' THEN false WHEN comparison LIKE 'less%' THEN has_upper ELSE has_lower END)
WHEN 'enclosure' THEN model IN ('exact', 'interval') ELSE has_nominal END AS satisfies
FROM (SELECT r.*, c.model, c.lower_minor IS NOT NULL AS has_lower, c.upper_minor IS NOT NULL AS has_upper, c.nominal_minor IS NOT NULL AS has_nominal FROM f_claims c JOIN f_requirements r USING (requirement_id)) x
GROUP BY basis, comparison, model, has_lower, has_upper, has_nominal""")
def j3_model_satisfies_basis(v):
    rows = v("f_claims").join(v("f_requirements"), "requirement_id").select("basis", "comparison", "model", *[F.col(f"{c}_minor").isNotNull().alias(f"has_{c}") for c in ("lower", "upper", "nominal")])
    return verdicts.model_satisfies_basis(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))


@query("""SELECT claim_id, requirement_id, kind, comparison, nominal_minor FROM f_requirements LEFT JOIN f_claims USING (requirement_id)""")
def c1_bind_claims(v):
    return verdicts.bind_claims(v("f_requirements"), v("f_claims"), REQUIREMENT).select("claim_id", "requirement_id", "kind", "comparison", "nominal_minor")


VALUES = """SELECT claim_id, CASE claim_id % 7 WHEN 0 THEN 'mass' WHEN 1 THEN 'time' ELSE 'money' END AS kind,
CASE claim_id % 5 WHEN 0 THEN 'usd' WHEN 1 THEN 'mill' WHEN 2 THEN 'kg' WHEN 3 THEN 'furlong' ELSE 'cent' END AS unit, nominal_minor AS value FROM f_claims"""


@query(f"""SELECT claim_id, CAST(scaled_num AS BIGINT) AS scaled_num, CAST(scaled_den AS BIGINT) AS scaled_den, canonical_unit,
CASE WHEN kind = 'time' THEN 'unknown_kind' WHEN scaled_den IS NOT NULL THEN NULL WHEN unit = 'furlong' THEN 'unknown_unit' ELSE 'other_kind_unit' END AS unit_problem,
CASE WHEN kind <> 'time' AND scaled_den IS NULL AND unit = 'furlong' THEN CASE kind WHEN 'money' THEN 'cent,mill,usd' ELSE 'g,kg' END END AS candidates
FROM (SELECT x.*, value * factor_num AS scaled_num, factor_den AS scaled_den, CASE x.kind WHEN 'money' THEN 'cent' WHEN 'mass' THEN 'kg' END AS canonical_unit FROM ({VALUES}) x LEFT JOIN f_kinds k ON k.kind = x.kind AND k.unit = x.unit) y""")
def c2_scale_units(v):
    kind = F.when(F.col("claim_id") % 7 == 0, "mass").when(F.col("claim_id") % 7 == 1, "time").otherwise("money")
    turn = F.col("claim_id") % 5
    unit = F.when(turn == 0, "usd").when(turn == 1, "mill").when(turn == 2, "kg").when(turn == 3, "furlong").otherwise("cent")
    rows = v("f_claims").select("claim_id", kind.alias("kind"), unit.alias("unit"), F.col("nominal_minor").alias("value"))
    out = units.scale_units(rows, v("f_kinds"))
    return out.select("claim_id", F.col("scaled_num").cast("long"), F.col("scaled_den").cast("long"), "canonical_unit", "unit_problem", F.array_join("unit_candidates", ",").alias("candidates"))


@query("""SELECT p_brand AS kind, problem FROM (SELECT p_brand, bool_or(n > 1) AS twice, bool_or(canonical) AS canonical, bool_or(bad) AS bad FROM (
SELECT p_brand, p_size AS unit, count(*) AS n, bool_or(p_partkey % 50 = p_size) AS canonical, bool_or(p_partkey % 50 <= 0) AS bad FROM part GROUP BY p_brand, p_size) s GROUP BY p_brand) t,
(VALUES ('duplicate_unit'), ('no_canonical_unit'), ('factor_not_positive')) AS p(problem) WHERE CASE problem WHEN 'duplicate_unit' THEN twice WHEN 'no_canonical_unit' THEN NOT canonical ELSE bad END""")
def b13_check_kinds(v):
    kinds = v("part").select(F.col("p_brand").alias("kind"), F.col("p_size").alias("unit"), (F.col("p_partkey") % 50).alias("factor_num"), F.col("p_size").alias("factor_den"))
    return units.check_kinds(kinds)


@query("""SELECT requirement_id, n_claims, rule, CASE WHEN rule LIKE 'not_evaluated%' THEN 'not_evaluated' WHEN rule LIKE '%.match' THEN 'pass' ELSE 'fail' END AS status FROM (
SELECT o_orderkey AS requirement_id, count(l_orderkey) AS n_claims, CASE WHEN o_orderkey % 11 = 0 THEN 'not_evaluated.kernel_refusal' WHEN count(l_orderkey) = 0 THEN 'not_evaluated.missing'
WHEN bool_or(l_returnflag = 'R') THEN 'not_evaluated.quarantined' WHEN count(l_orderkey) > 1 THEN 'not_evaluated.duplicate_claim' WHEN max(l_linestatus) IS NULL THEN 'not_evaluated.category_missing'
WHEN o_orderkey % 2 = 0 THEN 'categorical.equals.' || CASE WHEN max(l_linestatus) = 'O' THEN 'match' ELSE 'mismatch' END ELSE 'categorical.in_set.match' END AS rule
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) x""")
def b8_categorical_match(v):
    even = F.col("o_orderkey") % 2 == 0
    accepted = F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("O"), F.lit("O"))).when(even, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("F")))
    reqs = v("orders").select(F.col("o_orderkey").alias("requirement_id"), F.when(even, "equals").otherwise("in_set").alias("comparison"), accepted.alias("accepted"))
    claims = v("lineitem").select(
        F.col("l_orderkey").alias("requirement_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("claim_id"), F.col("l_linenumber").alias("ordinal"),
        F.when(F.col("l_returnflag") == "R", "quarantined").otherwise("admitted").alias("state"), F.col("l_linestatus").alias("value"))
    return verdicts.categorical_match(reqs, claims)


@query(f"""SELECT attempt_id, requirement_id, CAST(10 * (((upper * 1 - ((upper % 1000) + 1000) % 1000) // 1000) + CASE WHEN 2 * (((upper % 1000) + 1000) % 1000) > 1000 OR (2 * (((upper % 1000) + 1000) % 1000) = 1000 AND ((upper - ((upper % 1000) + 1000) % 1000) // 1000) % 2 <> 0) THEN 1 ELSE 0 END) AS BIGINT) AS display_upper
FROM ({PER_ATTEMPT}) x WHERE upper IS NOT NULL""")
def h6_display_upper(v):
    shown = verdicts.display_upper(attempts(v), 100, 1, 10)
    return shown.filter("upper is not null").select("attempt_id", "requirement_id", "display_upper")
