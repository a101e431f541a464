"""Queries over admission, policy, coverage, qualification and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import admission, policy, predicates
from assayer.operators.verdicts import _shape_ok
from assayer.plans.history_queries import spark_sql
from assayer.plans.registry import query

SHA = "'sha256:' || repeat(CAST({} % 10 AS VARCHAR(2)), {})"
# Every ninth order attests the next one in its own place.
J1_ATT = "SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS input_id, 'sha256:' || repeat(CAST(o_orderkey % 10 AS VARCHAR(2)), CASE WHEN o_orderkey % 11 = 0 THEN 63 ELSE 64 END) AS sha256, CASE WHEN o_orderkey % 7 = 0 THEN 'text' ELSE 'json' END AS media_type FROM orders"


@query(f"""SELECT o_orderkey AS input_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 OR NOT ok OR other THEN 'quarantined' ELSE 'admitted' END AS state,
concat_ws(',', CASE WHEN n > 1 THEN 'duplicate_attestation' END, CASE WHEN NOT ok THEN 'malformed_digest' END, CASE WHEN other THEN 'media_type_mismatch' END) AS reasons
FROM orders LEFT JOIN (SELECT input_id, count(*) AS n, bool_and(length(sha256) = 71) AS ok, bool_or(media_type <> 'json') AS other FROM ({J1_ATT}) a GROUP BY input_id) g ON g.input_id = o_orderkey""")
def j1_admit_inputs(v):
    inputs = v("orders").select(F.col("o_orderkey").alias("input_id"), F.lit("json").alias("media_type"))
    out = admission.admit_inputs(inputs, spark_sql(v, J1_ATT, "orders"))
    return out.select("input_id", "state", F.array_join("reasons", ",").alias("reasons"))


# Orders are steps, their lines are claims; steps form trees of two levels below a root.
J2_EDGES = "SELECT o_orderkey AS step_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey - o_orderkey % 4 ELSE o_orderkey - o_orderkey % 64 END AS parent_step FROM orders WHERE o_orderkey % 64 > 0"
J2_CLAIMS = "SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS step_id, CAST(l_linenumber - 1 + 7 * (l_suppkey % 2) AS BIGINT) AS slot, CASE WHEN l_orderkey % 19 = 0 THEN 'text' ELSE 'json' END AS media_type, CASE WHEN l_orderkey % 23 = 0 THEN 'unquantified' ELSE 'exact' END AS model, l_orderkey % 29 = 0 AS partial, CASE WHEN l_orderkey % 31 <> 0 THEN l_orderkey END AS nominal_minor, CAST(NULL AS BIGINT) AS lower_minor, CAST(NULL AS BIGINT) AS upper_minor, CAST(NULL AS DOUBLE) AS coverage FROM lineitem"
J2_LOCAL = "SELECT *, list_filter([CASE WHEN slot > 12 THEN 'undeclared_slot' END, CASE WHEN count(*) OVER (PARTITION BY step_id, slot) > 1 THEN 'duplicate_claim' END, CASE WHEN slot <= 12 AND media_type <> 'json' THEN 'media_type_mismatch' END, CASE WHEN partial AND NOT (slot <= 12 AND step_id % 2 = 0) THEN 'partial_not_permitted' END, CASE WHEN slot <= 12 AND model = 'unquantified' THEN 'model_not_permitted' END, CASE WHEN nominal_minor IS NULL THEN 'claim_shape' END], lambda x : x IS NOT NULL) AS loc FROM (" + J2_CLAIMS + ") c"


@query(f"""WITH RECURSIVE j AS MATERIALIZED ({J2_LOCAL}), f(step_id) AS (
SELECT DISTINCT step_id FROM j WHERE len(loc) > 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0
UNION SELECT e.step_id FROM f JOIN ({J2_EDGES}) e ON e.parent_step = f.step_id),
b AS (SELECT DISTINCT e.step_id FROM f JOIN ({J2_EDGES}) e ON e.parent_step = f.step_id UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 0)
SELECT claim_id, CASE WHEN len(loc) > 0 OR b.step_id IS NOT NULL THEN 'quarantined' ELSE 'admitted' END AS state,
array_to_string(list_concat(loc, CASE WHEN b.step_id IS NOT NULL THEN ['parent_not_admitted'] ELSE [] END), ',') AS reasons FROM j LEFT JOIN b USING (step_id)""")
def j2_admit_claims(v):
    claims = spark_sql(v, J2_CLAIMS, "lineitem")
    step = F.col("o_orderkey")
    slots = v("orders").select(step.alias("step_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("slot"), F.lit("json").alias("media_type"), F.array(F.lit("exact")).alias("models"), (step % 2 == 0).alias("partial_allowed"))
    steps = spark_sql(v, J2_EDGES, "orders").withColumn("parent_input", F.lit(None).cast("long"))
    given = v("orders").filter("o_orderkey % 97 = 0").select(step.alias("step_id"), F.lit(None).cast("long").alias("parent_step"), step.alias("parent_input"))
    inputs = v("orders").select(step.alias("input_id"), F.when(step % 97 == 0, "missing").otherwise("admitted").alias("state"))
    out = admission.admit_claims(claims, slots, steps.unionByName(given), inputs, _shape_ok())
    return out.select("claim_id", "state", F.array_join("reasons", ",").alias("reasons"))


QSTATES = "list_extract(['not_recognised', 'revoked', 'superseded', 'expired', 'outside', 'unknown', 'inside'], CAST(1 + (claim_id * 7 + requirement_id) % 40 AS INTEGER))"


@query(f"""WITH c AS (SELECT requirement_id, CASE WHEN (claim_id * 7 + requirement_id) % 400 < 6 THEN 1 + (claim_id * 7 + requirement_id) % 400 WHEN claim_id % 50 <> 0 THEN 7 END AS r FROM f_claims),
g AS (SELECT requirement_id, min(r) AS worst, bool_or(r IS NULL) AS bare FROM c GROUP BY requirement_id)
SELECT requirement_id, rule, rule IS NULL AND basis <> 'nominal' AND coalesce(bare, false) AS notice FROM (SELECT q.requirement_id, basis, bare, CASE WHEN basis <> 'nominal' AND worst < 7 THEN 'not_evaluated.' || list_extract(['not_recognised', 'revoked', 'superseded', 'expired', 'outside', 'unknown'], CAST(worst AS INTEGER))
WHEN basis <> 'nominal' AND bare AND q.requirement_id % 2 = 0 AND q.requirement_id % 5 <> 0 THEN 'not_evaluated.unqualified' END AS rule FROM f_requirements q LEFT JOIN g ON g.requirement_id = q.requirement_id) x""")
def j4_qualification_gate(v):
    place = (F.col("claim_id") * 7 + F.col("requirement_id")) % 400
    states = F.array(*map(F.lit, admission.GATE))
    state = F.when(place < 6, F.element_at(states, (place + 1).cast("int"))).when(F.col("claim_id") % 50 != 0, "inside")
    claims = v("f_claims").select("requirement_id", state.alias("qualification_state"), "claim_id")
    reqs = v("f_requirements").withColumns({"categorical": F.col("requirement_id") % 5 == 0, "qualification_required": F.col("requirement_id") % 2 == 0})
    return admission.qualification_gate(reqs, claims)


@query("""SELECT p_partkey AS record_id, CASE WHEN p_partkey % 17 = 0 THEN 'revoked' WHEN p_partkey IN (SELECT p_partkey * 2 FROM part WHERE p_partkey % 3 = 0 UNION SELECT p_partkey + 5 FROM part WHERE p_partkey % 3 = 0) THEN 'superseded' ELSE 'live' END AS state FROM part""")
def j5_supersession_state(v):
    records = v("part").select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("record_sha256"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.col("p_partkey") * 2, F.col("p_partkey") + 5)).alias("supersedes"))
    return admission.supersession_state(records, v("part").filter("p_partkey % 17 = 0").select(F.col("p_partkey").alias("record_sha256")))


J6_POLICY = """SELECT c_custkey AS policy_id, c_nationkey AS floor_id, CASE WHEN c_custkey % 3 > 0 THEN array('p1', concat('p', c_custkey % 4)) END AS deny_providers, CASE WHEN c_custkey % 5 > 1 THEN array('a1', concat('a', c_custkey % 3)) END AS allow_providers,
CASE WHEN c_custkey % 2 = 0 THEN array('r1') ELSE array('r2') END AS permitted_roles, c_custkey % 4 = 0 AS permit_nominal_basis, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 6 END AS min_maturity, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 * 10 END AS cost_cap, CASE WHEN c_custkey % 11 = 0 THEN 'eur' ELSE 'usd' END AS currency FROM customer"""
J6_FLOOR = """SELECT CAST(n_nationkey AS BIGINT) AS floor_id, array('p1', concat('p', n_nationkey % 4)) AS deny_providers, CASE WHEN n_nationkey % 3 > 0 THEN array('a1', 'a2') END AS allow_providers, array('r1', 'r3') AS permitted_roles, n_nationkey % 2 = 0 AS permit_nominal_basis, n_nationkey % 5 AS min_maturity, n_nationkey % 4 * 15 AS cost_cap, 'usd' AS currency FROM nation"""


def _lists(sql: str) -> str:
    return sql.replace("array(", "list_value(")


@query(f"""WITH b AS (SELECT p.*, f.deny_providers AS fd, f.allow_providers AS fa, f.permitted_roles AS fr, f.permit_nominal_basis AS fn, f.min_maturity AS fm, f.cost_cap AS fc, f.currency AS fu FROM ({_lists(J6_POLICY)}) p JOIN ({_lists(J6_FLOOR)}) f USING (floor_id))
SELECT policy_id, 'deny_providers' AS problem FROM b WHERE deny_providers IS NOT NULL AND NOT list_has_all(deny_providers, fd) UNION ALL SELECT policy_id, 'allow_providers' FROM b WHERE allow_providers IS NOT NULL AND fa IS NOT NULL AND NOT list_has_all(fa, allow_providers)
UNION ALL SELECT policy_id, 'permitted_roles' FROM b WHERE NOT list_has_all(fr, permitted_roles) UNION ALL SELECT policy_id, 'permit_nominal_basis' FROM b WHERE permit_nominal_basis AND NOT fn UNION ALL SELECT policy_id, 'min_maturity' FROM b WHERE min_maturity < fm
UNION ALL SELECT policy_id, 'cost_cap' FROM b WHERE cost_cap IS NOT NULL AND (currency <> fu OR cost_cap > fc)""")
def j6_policy_tightens(v):
    return policy.policy_tightens(spark_sql(v, J6_POLICY, "customer"), spark_sql(v, J6_FLOOR, "nation"))[0]


@query(f"""SELECT policy_id, array_to_string(coalesce(p.deny_providers, f.deny_providers), ',') AS deny_providers, array_to_string(coalesce(p.allow_providers, f.allow_providers, []), ',') AS allow_providers, p.permit_nominal_basis OR f.permit_nominal_basis AS permit_nominal_basis,
coalesce(p.min_maturity, f.min_maturity) AS min_maturity, coalesce(p.cost_cap, f.cost_cap) AS cost_cap FROM ({_lists(J6_POLICY)}) p JOIN ({_lists(J6_FLOOR)}) f USING (floor_id)""")
def j6_merged_policies(v):
    merged = policy.policy_tightens(spark_sql(v, J6_POLICY, "customer"), spark_sql(v, J6_FLOOR, "nation"))[1]
    return merged.select("policy_id", F.array_join("deny_providers", ",").alias("deny_providers"), F.array_join("allow_providers", ",").alias("allow_providers"), "permit_nominal_basis", "min_maturity", "cost_cap")


J7_SEL = "SELECT o_orderkey AS step_id, o_custkey AS policy_id, CASE WHEN o_orderkey % 13 > 0 THEN 1 END AS winner, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS bound, o_orderkey % 5 = 0 AS confirmed, o_orderkey % 3 = 0 AS self_check, o_orderkey % 4 = 0 AS own FROM orders"
J7_CAND = "SELECT l_orderkey AS step_id, l_linenumber AS capability_id, CASE WHEN l_partkey % 41 > 0 THEN 'ok' END AS decision, concat('s', l_suppkey) AS provider, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 7 END AS maturity, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_quantity AS BIGINT) END AS cost, array(concat('c', l_partkey % 12)) AS criteria, concat('b', l_partkey) AS bytes FROM lineitem"
J7_POL = "SELECT c_custkey AS policy_id, array(concat('s', c_custkey % 50)) AS deny_providers, CASE WHEN c_custkey % 8 = 0 THEN array('s1', 's2') END AS allow_providers, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 END AS min_maturity, CASE WHEN c_custkey % 4 > 0 THEN 30 END AS cost_cap, array('c0') AS banned_criteria, array('c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c9') AS known_criteria, c_custkey % 2 = 0 AS forbid_self_preference, c_custkey % 5 = 0 AS independent, c_custkey % 6 = 0 AS diverse FROM customer"


@query(f"""WITH s AS (SELECT * FROM ({J7_SEL}) a), c AS (SELECT * FROM ({_lists(J7_CAND)}) a), p AS (SELECT * FROM ({_lists(J7_POL)}) a),
g AS (SELECT step_id, bool_or(decision IS NULL) AS undecided, list_distinct(flatten(list(criteria))) AS used FROM c GROUP BY step_id),
r AS (SELECT s.*, undecided, used, provider, maturity, cost, bytes, p.* EXCLUDE (policy_id) FROM s LEFT JOIN g USING (step_id) LEFT JOIN c ON c.step_id = s.step_id AND c.capability_id = s.winner LEFT JOIN p USING (policy_id)),
w AS (SELECT *, count(provider) OVER (PARTITION BY policy_id, provider) AS n_owner, count(bytes) OVER (PARTITION BY policy_id, bytes) AS n_bytes FROM r)
{' UNION ALL '.join(f"SELECT step_id, '{k}' AS problem FROM w WHERE {x}" for k, x in {
    'undecided_candidate': 'undecided', 'banned_criterion': 'list_has_any(used, banned_criteria)', 'unknown_criterion': 'NOT list_has_all(list_concat(known_criteria, banned_criteria), used)', 'no_winner': 'winner IS NULL', 'winner_not_bound': 'winner <> bound',
    'provider_denied': 'list_contains(deny_providers, provider)', 'provider_not_allowed': 'allow_providers IS NOT NULL AND NOT list_contains(allow_providers, provider)', 'maturity_below_floor': 'min_maturity IS NOT NULL AND NOT coalesce(maturity >= min_maturity, false)',
    'self_preference_unchecked': 'forbid_self_preference AND own AND NOT self_check', 'cost_over_cap': 'cost_cap IS NOT NULL AND NOT coalesce(cost <= cost_cap, false) AND NOT confirmed', 'shared_provider': 'independent AND provider IS NOT NULL AND n_owner > 1', 'identical_bytes': 'diverse AND bytes IS NOT NULL AND n_bytes > 1'}.items())}""")
def j7_selection_checks(v):
    return policy.selection_checks(spark_sql(v, J7_SEL, "orders"), spark_sql(v, J7_CAND, "lineitem"), spark_sql(v, J7_POL, "customer"))


J8 = "SELECT p_partkey AS rule_id, CAST(FLOOR(p_partkey / 2) AS BIGINT) AS src_step, p_partkey + p_partkey % 2 AS dst_step, 'a' AS dst_slot, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'j' END AS justification, CASE WHEN p_partkey % 5 > 0 THEN array(p_partkey) END AS evidence, p_size AS not_after, p_partkey % 30 AS key_id FROM part"


@query(f"""WITH r AS (SELECT r.*, e.dst_step IS NOT NULL AS edge FROM ({_lists(J8)}) r LEFT JOIN f_edges e USING (src_step, dst_step, dst_slot))
SELECT rule_id, 'not_justified' AS problem FROM r WHERE trim(justification) = '' UNION ALL SELECT rule_id, 'no_evidence' FROM r WHERE evidence IS NULL UNION ALL SELECT rule_id, 'no_edge' FROM r WHERE NOT edge UNION ALL SELECT rule_id, 'expired' FROM r WHERE 10 >= not_after
UNION ALL SELECT rule_id, 'key_not_authorised' FROM r WHERE key_id > 24 OR key_id % 2 = 1 UNION ALL SELECT rule_id, 'usable' FROM r WHERE trim(justification) <> '' AND evidence IS NOT NULL AND edge AND 10 < not_after AND key_id <= 24 AND key_id % 2 = 0""")
def j8_reuse_rule_filter(v):
    keys = v("nation").select(F.col("n_nationkey").cast("long").alias("key_id"), F.when(F.col("n_nationkey") % 2 == 0, "policy_owner").otherwise("runner").alias("role"))
    good, refused = policy.reuse_rule_filter(spark_sql(v, J8, "part"), v("f_edges"), keys, F.lit(10))
    return refused.unionByName(good.select("rule_id", F.lit("usable").alias("problem")))


# Odd parts have no mapping; a quarter of all requirements is mapped, partly to sets of another comparison.
D5_MAP = "SELECT DISTINCT l_partkey - 5 * (l_partkey % 6) AS set_id, l_partkey - l_partkey % 4 AS requirement_id FROM lineitem"
D5_SET = "SELECT p_partkey AS set_id, CASE WHEN p_partkey % 9 = 0 THEN 'mass' ELSE 'money' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'less_than' WHEN 1 THEN 'less_than_or_equal' WHEN 2 THEN 'greater_than' WHEN 3 THEN 'greater_than_or_equal' ELSE 'equal' END AS comparison, CASE p_partkey % 3 WHEN 0 THEN 'nominal' WHEN 1 THEN 'bounded' ELSE 'enclosure' END AS minimum_basis, p_partkey % 4 = 0 AS may_omit FROM part"


@query(f"""WITH m AS (SELECT set_id, r.*, q.basis, q.kind = s.kind AND q.comparison = s.comparison AS fits, CASE q.basis WHEN 'nominal' THEN 0 WHEN 'bounded' THEN 1 ELSE 2 END >= CASE s.minimum_basis WHEN 'nominal' THEN 0 WHEN 'bounded' THEN 1 ELSE 2 END AS strong
 FROM ({D5_SET}) s JOIN ({D5_MAP}) r USING (set_id) LEFT JOIN f_requirements q ON q.requirement_id = r.requirement_id),
g AS (SELECT set_id, bool_or(fits) AS covers, bool_or(fits AND strong) AS adequate, count(*) FILTER (NOT fits) AS misfits FROM m GROUP BY set_id)
SELECT set_id, state, coalesce(misfits, 0) + CASE WHEN state IN ('covered_under_basis', 'omitted_unstated') THEN 1 ELSE 0 END AS n_issues FROM (
SELECT s.set_id, misfits, CASE WHEN adequate THEN 'covered' WHEN covers THEN 'covered_under_basis' WHEN s.set_id % 6 = 1 AND s.set_id % 12 <> 1 AND s.set_id NOT IN (SELECT set_id FROM ({D5_MAP}) z) THEN 'omitted_stated' WHEN may_omit THEN 'omissible' ELSE 'omitted_unstated' END AS state
FROM ({D5_SET}) s LEFT JOIN g ON g.set_id = s.set_id) x""")
def d5_assess_coverage(v):
    entries = spark_sql(v, D5_SET, "part")
    said = entries.filter("set_id % 6 = 1").select("set_id", F.lit("why").alias("reason"), F.when(F.col("set_id") % 12 == 1, " ").otherwise("who").alias("accepted_by"))
    return admission.assess_coverage(entries, spark_sql(v, D5_MAP, "lineitem"), said, v("f_requirements"))


@query(f"SELECT requirement_id FROM f_requirements WHERE requirement_id NOT IN (SELECT requirement_id FROM ({D5_MAP}) m)")
def d6_additional_requirements(v):
    return admission.additional_requirements(v("f_requirements"), spark_sql(v, D5_MAP, "lineitem"))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 15 = 0 THEN 'expired' WHEN least_ = 0 THEN 'outside' WHEN least_ = 1 THEN 'unknown' ELSE 'inside' END AS state FROM orders LEFT JOIN (
SELECT l_orderkey, min(CASE WHEN l_quantity > 48 THEN 0 WHEN l_linenumber = 4 AND l_quantity > 25 THEN 1 ELSE 2 END) AS least_ FROM lineitem GROUP BY l_orderkey) t ON l_orderkey = o_orderkey""")
def d7_envelope_state(v):
    truth = F.when(F.col("l_quantity") > 48, False).when((F.col("l_linenumber") == 4) & (F.col("l_quantity") > 25), None).otherwise(True)
    return admission.envelope_state(v("lineitem").select(F.col("l_orderkey").alias("record_id"), truth.alias("truth")), v("orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 15 == 0).alias("expired")))


@query("""SELECT p_partkey AS id, kind FROM part, (VALUES ('input'), ('output')) k(kind) WHERE NOT (kind = 'input' AND p_partkey IN (SELECT src_step FROM f_edges)) AND NOT (kind = 'output' AND p_partkey IN (SELECT step_id FROM f_claims WHERE state = 'admitted'))""")
def c5_unconsumed_inputs(v):
    declared = v("part").select(F.explode(F.array(F.lit("input"), F.lit("output"))).alias("kind"), F.col("p_partkey").alias("id"))
    used = v("f_edges").select(F.lit("input").alias("kind"), F.col("src_step").alias("id"))
    return admission.unconsumed(declared, used, v("f_claims").filter("state = 'admitted'").select(F.lit("output").alias("kind"), F.col("step_id").alias("id")))


@query("""SELECT dst_step AS step_id, count(*) AS n_open FROM f_edges WHERE src_step % 3 = 0 AND dst_step IN (SELECT requirement_id FROM f_claims) GROUP BY dst_step""")
def c6_parents_admitted(v):
    edges = v("f_edges").select(F.col("dst_step").alias("step_id"), F.col("src_step").alias("parent"))
    return admission.parents_admitted(v("f_claims").select(F.col("requirement_id").alias("step_id")), edges, v("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("parent")))


@query("""SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 10 = 0 THEN 'none' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'expired' ELSE 'current' END AS qualification_state FROM orders""")
def c11_qualification_as_of(v):
    claims = v("orders").select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("qualification_id"), F.col("o_orderdate").alias("evaluated_at"))
    records = v("customer").select(F.col("c_custkey").alias("qualification_id"), F.lit("1998-01-01").cast("timestamp").alias("not_after"))
    return admission.qualification_as_of(claims, records).select("claim_id", "qualification_state")


@query("""WITH s AS (SELECT p_partkey AS slot_id, p_brand || CAST(p_size AS VARCHAR) AS role FROM part), c AS (SELECT p_partkey AS source_id, p_brand || CAST(p_size AS VARCHAR) AS role FROM part WHERE p_partkey % 2 = 0)
SELECT slot_id, slot_id * 10 AS source_id, 'explicit' AS outcome, NULL AS n_candidates FROM s WHERE slot_id % 7 = 0 UNION ALL
SELECT slot_id, CASE WHEN n = 1 THEN only_ END, CASE WHEN n = 1 THEN 'bound' WHEN n IS NULL THEN 'none' ELSE 'ambiguous' END, coalesce(n, 0) FROM s LEFT JOIN (SELECT role, count(*) AS n, min(source_id) AS only_ FROM c GROUP BY role) g USING (role) WHERE slot_id % 7 <> 0""")
def c12_auto_bind(v):
    role = F.concat("p_brand", F.col("p_size").cast("string"))
    slots = v("part").select(F.col("p_partkey").alias("slot_id"), role.alias("role"))
    sources = v("part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id"), role.alias("role"))
    return admission.auto_bind(slots, sources, slots.filter("slot_id % 7 = 0").select("slot_id", (F.col("slot_id") * 10).alias("source_id")))


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 50 > 24 THEN 'unknown_key' WHEN o_custkey % 50 % 2 = 0 THEN 'authorized' ELSE 'wrong_role' END AS decision FROM orders""")
def c15_authorize_keys(v):
    keys = v("nation").select(F.col("n_nationkey").cast("long").alias("key_id"), F.when(F.col("n_nationkey") % 2 == 0, "runner").otherwise("requester").alias("role"))
    return admission.authorize_keys(v("orders").select(F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 50).alias("key_id")), keys, "runner")


@query("""SELECT l_orderkey * 10 + l_linenumber AS step_id, slot, s_suppkey AS record_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey % 2 = l_partkey % 2, (VALUES ('a'), ('b')) t(slot) WHERE s_suppkey % 3 = 0 OR slot = 'a'""")
def c20_attach_qualifications(v):
    slots = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("slot")
    steps = v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("step_id"), slots, F.col("l_suppkey").alias("capability_id"), (F.col("l_partkey") % 2).alias("executable"))
    records = v("supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_suppkey").alias("capability_id"), (F.col("s_nationkey") % 2).alias("executable"), F.when(F.col("s_suppkey") % 3 != 0, F.array(F.lit("a"))).alias("covered_slots"))
    return admission.attach_qualifications(records, steps)


@query("""SELECT c_custkey, 'bad_id:c_name' AS problem FROM customer WHERE NOT regexp_full_match(replace(c_name, '#', CASE WHEN c_custkey % 3 = 0 THEN '#' ELSE '-' END), '[A-Za-z0-9][A-Za-z0-9._-]{0,127}')
UNION ALL SELECT c_custkey, 'bad_digest:digest' FROM customer WHERE c_custkey % 4 <> 0""")
def b5_check_identifiers(v):
    df = v("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.translate("c_name", "#", "-")).alias("c_name"), F.concat(F.lit("sha256:"), F.when(F.col("c_custkey") % 4 == 0, F.sha2("c_name", 256)).otherwise(F.lit("ABC"))).alias("digest"))
    return admission.check_identifiers(df, ["c_name"], ["digest"], "c_custkey")


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS value_id, l_linenumber AS param, l_quantity AS number, l_returnflag AS text FROM lineitem)
SELECT value_id, 'no_domain' AS problem FROM x WHERE param > 5 UNION ALL SELECT value_id, 'below' FROM x WHERE param <= 5 AND (number < 5 OR (number = 5 AND param % 2 = 0)) UNION ALL SELECT value_id, 'above' FROM x WHERE param <= 5 AND (number > 45 OR (number = 45 AND param % 2 = 1))
UNION ALL SELECT value_id, 'not_a_member' FROM x WHERE param <= 5 AND param % 3 = 0 AND text = 'N'""")
def b7_check_value_domains(v):
    domains = v("lineitem").select(F.col("l_linenumber").alias("param")).distinct().filter("param <= 5").select(
        "param", F.lit(5.0).alias("low"), (F.col("param") % 2 == 1).alias("low_inclusive"), F.lit(45.0).alias("high"), (F.col("param") % 2 == 0).alias("high_inclusive"), F.when(F.col("param") % 3 == 0, F.array(F.lit("A"), F.lit("R"))).alias("members"))
    values = v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("value_id"), F.col("l_linenumber").alias("param"), F.col("l_quantity").alias("number"), F.col("l_returnflag").alias("text"))
    return admission.check_value_domains(values, domains)


@query("SELECT l_partkey, count(*) AS n, min(l_orderkey) AS first_place, max(l_orderkey) AS last_place FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def d20_find_duplicate_ids(v):
    return admission.find_duplicate_ids(v("lineitem"), "l_partkey", "l_orderkey")


@query("""SELECT l_partkey AS proposition, l_linenumber AS scope, count(*) FILTER (l_returnflag = 'A') AS n_for, count(*) FILTER (l_returnflag <> 'A') AS n_against FROM lineitem GROUP BY l_partkey, l_linenumber HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A')""")
def d22_contradictions(v):
    return admission.contradictions(v("lineitem").select(F.col("l_partkey").alias("proposition"), F.col("l_linenumber").alias("scope"), (F.col("l_returnflag") == "A").alias("asserted")))


@query("""SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'artifact', CAST(page_id AS VARCHAR), sha256(html) FROM pages UNION ALL SELECT 'supplied_input', CAST(item_id AS VARCHAR), sha256(text) FROM benchmark""")
def g1_artifact_view(v):
    pick = lambda t, i, c: v(t).select(F.col(i).cast("string").alias("id"), F.sha2(c, 256).alias("sha256"))
    return policy.artifact_view(pick("documents", "doc_id", "text"), pick("pages", "page_id", "html"), pick("benchmark", "item_id", "text"))


G2 = "SELECT l_orderkey AS app, l_returnflag AS kind, l_partkey % 50 AS id, {} AS state FROM lineitem"
G2_AFTER = "CASE WHEN l_partkey % 60 = 0 THEN 'X' ELSE l_linestatus END"


@query(f"""WITH a AS (SELECT DISTINCT * FROM ({G2.format('l_linestatus')}) x), b AS (SELECT DISTINCT * FROM ({G2.format(G2_AFTER)}) x)
SELECT app, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) d GROUP BY app""")
def g2_changed_premise_kinds(v):
    return policy.changed_premise_kinds(spark_sql(v, G2.format("l_linestatus"), "lineitem"), spark_sql(v, G2.format(G2_AFTER), "lineitem"), ["app"])


@query("""SELECT coalesce(o.o_custkey, c.c_custkey) AS id, CASE WHEN o.o_custkey IS NULL THEN 'extra' WHEN c.c_custkey IS NULL THEN 'missing' ELSE 'both' END AS state FROM (SELECT DISTINCT CASE WHEN o_custkey % 5 = 0 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey FROM orders) o FULL JOIN (SELECT CASE WHEN c_custkey % 4 = 0 THEN 0 - c_custkey ELSE c_custkey END AS c_custkey FROM customer) c ON o_custkey = c_custkey""")
def g3_policy_document_diff(v):
    # Ids of either side are spoiled, so that some miss their partner.
    ordered = v("orders").selectExpr("CASE WHEN o_custkey % 5 = 0 THEN -1 - o_custkey ELSE o_custkey END AS id")
    return policy.policy_document_diff(ordered, v("customer").selectExpr("CASE WHEN c_custkey % 4 = 0 THEN 0 - c_custkey ELSE c_custkey END AS id"), "id")


@query(f"""SELECT policy_id, deny_providers IS NULL OR list_has_all(deny_providers, fd) AS deny_tightens, allow_providers IS NULL OR fa IS NULL OR list_has_all(fa, allow_providers) AS allow_tightens, list_has_all(fr, permitted_roles) AS grants_tighten
FROM (SELECT p.*, f.deny_providers AS fd, f.allow_providers AS fa, f.permitted_roles AS fr FROM ({_lists(J6_POLICY)}) p JOIN ({_lists(J6_FLOOR)}) f USING (floor_id)) b""")
def g4_list_tightens(v):
    floors = spark_sql(v, J6_FLOOR, "nation")
    both = spark_sql(v, J6_POLICY, "customer").join(floors.select("floor_id", *[F.col(c).alias(f"f_{c}") for c in ("deny_providers", "allow_providers", "permitted_roles")]), "floor_id")
    kinds = (("deny", "deny_providers", "deny_tightens"), ("allow", "allow_providers", "allow_tightens"), ("grant", "permitted_roles", "grants_tighten"))
    return both.select("policy_id", *[policy.list_tightens(k, c, f"f_{c}").alias(a) for k, c, a in kinds])


@query("""SELECT o_orderkey AS record_id, problem FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 20 <> 0, (VALUES ('no_gate'), ('request_digest'), ('policy'), ('disposition'), ('reviewer_role'), ('record_digest')) p(problem)
WHERE CASE problem WHEN 'no_gate' THEN c_custkey IS NULL WHEN 'request_digest' THEN c_custkey IS NOT NULL AND o_orderkey % 7 = 0 WHEN 'policy' THEN c_custkey IS NOT NULL AND o_orderkey % 5 <> c_custkey % 5 AND o_orderkey % 3 = 0 WHEN 'disposition' THEN c_custkey IS NOT NULL AND o_orderstatus = 'P'
WHEN 'reviewer_role' THEN c_custkey IS NOT NULL AND o_orderkey % 11 = 0 ELSE o_orderkey % 13 = 0 END""")
def j21_check_routing(v):
    k = F.col("o_orderkey")
    records = v("orders").select(
        k.alias("record_id"), F.col("o_custkey").alias("step_id"), F.when(k % 7 == 0, -1).otherwise(F.col("o_custkey")).alias("request_sha256"), F.when(k % 3 == 0, k % 5).otherwise(F.col("o_custkey") % 5).alias("policy_id"),
        F.col("o_orderstatus").alias("disposition"), F.when(k % 11 == 0, "x").otherwise("r").alias("reviewer_role"), k.alias("record_sha256"), F.when(k % 13 == 0, k + 1).otherwise(k).alias("derived_sha256"))
    gates = v("customer").filter("c_custkey % 20 <> 0").select(F.col("c_custkey").alias("step_id"), F.col("c_custkey").alias("request_sha256"), (F.col("c_custkey") % 5).alias("policy_id"), F.array(F.lit("O"), F.lit("F")).alias("dispositions"), F.lit("r").alias("role"))
    return policy.check_routing(records, gates)


@query("""WITH s AS (SELECT p_partkey AS step_id, CASE p_partkey % 3 WHEN 0 THEN 'seeded' WHEN 1 THEN 'deterministic' ELSE 'nondeterministic' END AS class, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END AS seed, p_size % 3 AS role FROM part)
SELECT step_id, 'seed_missing' AS problem FROM s WHERE class = 'seeded' AND seed IS NULL UNION ALL SELECT step_id, 'seed_not_expected' FROM s WHERE class <> 'seeded' AND seed IS NOT NULL UNION ALL SELECT step_id, 'nondeterministic_role' FROM s WHERE class = 'nondeterministic' AND role = 2
UNION ALL SELECT DISTINCT l_partkey, 'factor_missing' FROM lineitem WHERE l_orderkey % 50 > 0 AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 75 > 0)
UNION ALL SELECT DISTINCT l_partkey, 'factor_extra' FROM lineitem WHERE l_orderkey % 75 > 0 AND (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 50 > 0)""")
def j23_check_reproducibility(v):
    k = F.col("p_partkey")
    steps = v("part").select(k.alias("step_id"), F.when(k % 3 == 0, "seeded").when(k % 3 == 1, "deterministic").otherwise("nondeterministic").alias("class"), F.when(k % 4 > 0, k).alias("seed"), (F.col("p_size") % 3).alias("role"), F.array(F.lit(0), F.lit(1)).alias("permitted_roles"))
    factors = lambda n: v("lineitem").filter(f"l_orderkey % {n} > 0").select(F.col("l_partkey").alias("step_id"), F.col("l_suppkey").alias("factor"))
    return policy.check_reproducibility(steps, factors(50), factors(75))


# Rule 1: any(all(price in range, not(brand in set)), fact size >= 40); rule 2: all(always, brand = x);
# rule 3: all of four typed facts, cost, flag, code and label.  Parts are contexts.
def _forest(v):
    spark = v("part").sparkSession
    fields = """node_id int, rule_id int, parent_id int, level int, op string, name string, source_class string, validator string, operand string, operand_type string,
 operand_unit string, kind string, low double, low_inclusive boolean, high double, high_inclusive boolean, members array<string>"""

    def node(node_id, rule_id, parent_id, level, op, name=None, source=None, fact=(None,) * 4, bounds=(None,) * 4, members=None):
        return (node_id, rule_id, parent_id, level, op, name, source, None, *fact, *bounds, members)

    nodes = [
        node(1, 1, None, 0, "any"), node(2, 1, 1, 1, "all"), node(3, 1, 2, 2, "param_range", "price", bounds=(950.0, True, 1200.0, False)), node(4, 1, 2, 2, "not"),
        node(5, 1, 4, 3, "attribute_in", "brand", members=["Brand#11", "Brand#12", "Brand#13"]), node(6, 1, 1, 1, "ge", "size", "measured", ("40", "integer", None, None)),
        node(7, 2, None, 0, "all"), node(8, 2, 7, 1, "always"), node(9, 2, 7, 1, "eq", "brand", fact=("Brand#22", "string", None, None)),
        node(10, 3, None, 0, "all"), node(11, 3, 10, 1, "le", "cost", fact=("1100.50", "quantity", "usd", "money")), node(12, 3, 10, 1, "eq", "flag", fact=("true", "boolean", None, None)),
        node(13, 3, 10, 1, "ne", "code", fact=("9007199254740993", "integer", None, None)), node(14, 3, 10, 1, "eq", "label", fact=("1.0", "string", None, None)),
    ]
    part, k = v("part"), F.col("p_partkey")
    none = F.lit(None).cast("string")

    def value(name, text, kind, number=F.lit(None).cast("double"), source=none, unit=none):
        return part.select(k.alias("context_id"), F.lit(name).alias("name"), source.alias("source_class"), none.alias("validator"), number.alias("number"), text.alias("text"), kind.alias("type"), unit.alias("unit"))

    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    mill = k % 2 == 0
    values = value("price", F.col("p_retailprice").cast("string"), F.lit("quantity"), F.col("p_retailprice")).filter("context_id % 7 <> 0")
    values = values.unionByName(value("brand", F.col("p_brand"), F.lit("string")).filter("context_id % 11 <> 0"))
    values = values.unionByName(value("size", F.col("p_size").cast("string"), F.lit("integer"), F.col("p_size").cast("double"), F.when(k % 5 == 0, "guessed").otherwise("measured")))
    unit = F.when(k % 17 == 0, "kg").when(mill, "mill").otherwise("cent")
    values = values.unionByName(value("cost", F.when(mill, cents * 10).otherwise(cents).cast("string"), F.lit("quantity"), unit=unit).filter("context_id % 13 <> 0"))
    values = values.unionByName(value("flag", F.when(F.col("p_size") > 25, "true").otherwise("false"), F.lit("boolean")))
    values = values.unionByName(value("code", F.when(mill, "9007199254740992").otherwise("9007199254740993"), F.lit("integer")))
    values = values.unionByName(value("label", F.when(k % 3 == 1, "1.0").otherwise("1"), F.when(k % 3 == 0, "integer").otherwise("string")))
    contexts = part.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rule_id"), k.alias("context_id"))
    return spark.createDataFrame(nodes, fields), values, contexts, v("f_kinds")


COST = "CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN CAST(ROUND(p_retailprice * 100) AS BIGINT) <= 110050 END"
LABEL = "CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 3 = 1 END"
B4_SQL = f"""SELECT rule_id, p_partkey AS context_id, CASE WHEN rule_id = 1 THEN (CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice >= 950 AND p_retailprice < 1200 END AND NOT CASE WHEN p_partkey % 11 <> 0 THEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') END) OR CASE WHEN p_partkey % 5 <> 0 THEN p_size >= 40 END
WHEN rule_id = 2 THEN CASE WHEN p_partkey % 11 <> 0 THEN p_brand = 'Brand#22' END ELSE {COST} AND p_size > 25 AND p_partkey % 2 = 0 AND {LABEL} END AS truth FROM part, (VALUES (1), (2), (3)) r(rule_id)"""


@query(B4_SQL)
def b4_evaluate_applicability(v):
    return predicates.evaluate_applicability(*_forest(v))


def _code(truth: str) -> str:
    return f"CASE WHEN ({truth}) IS NULL THEN 1 WHEN {truth} THEN 2 ELSE 0 END"


@query(f"""SELECT p_partkey AS context_id, node_id, CASE node_id WHEN 3 THEN CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_retailprice >= 950 AND p_retailprice < 1200 THEN 2 ELSE 0 END WHEN 5 THEN CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 2 ELSE 0 END
WHEN 6 THEN CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_size >= 40 THEN 2 ELSE 0 END WHEN 8 THEN 2 WHEN 9 THEN CASE WHEN p_partkey % 11 = 0 THEN 1 WHEN p_brand = 'Brand#22' THEN 2 ELSE 0 END
WHEN 11 THEN {_code(COST)} WHEN 12 THEN {_code('p_size > 25')} WHEN 13 THEN {_code('p_partkey % 2 = 0')} ELSE {_code(LABEL)} END AS code FROM part, (VALUES (3), (5), (6), (8), (9), (11), (12), (13), (14)) n(node_id)""")
def b4_leaf_truth(v):
    nodes, values, contexts, kinds = _forest(v)
    return predicates.leaf_truth(nodes.filter("op not in ('all', 'any', 'not')"), values, contexts, kinds)


@query(f"""WITH d AS (SELECT rule_id, context_id, CASE WHEN truth THEN 'eligible' WHEN NOT truth THEN 'ineligible' ELSE 'unknown' END AS derived FROM ({B4_SQL}) t),
r AS (SELECT p_partkey AS context_id, 1 AS rule_id, CASE WHEN p_size > 30 THEN 'eligible' ELSE 'ineligible' END AS recorded FROM part WHERE p_partkey % 3 = 0)
SELECT rule_id, context_id, derived, recorded, CASE WHEN recorded <> derived THEN 'mismatch' WHEN derived = 'eligible' THEN 'accepted' ELSE 'refused' END AS verdict FROM d FULL JOIN r USING (rule_id, context_id)""")
def j22_derive_eligibility(v):
    recorded = v("part").filter("p_partkey % 3 = 0").select(F.lit(1).alias("rule_id"), F.col("p_partkey").alias("context_id"), F.when(F.col("p_size") > 30, "eligible").otherwise("ineligible").alias("outcome"))
    nodes, values, contexts, kinds = _forest(v)
    return predicates.derive_eligibility(nodes, values, contexts, recorded, kinds)
