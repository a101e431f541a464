"""Queries over search campaigns: fronts, best and first runs, sweeps, calls, scores, surrogate models."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import search, skyline, surrogate
from assayer.plans.history_queries import spark_sql
from assayer.plans.registry import query
from assayer.storage import materialize
from assayer.plans.verdict_queries import PER_ATTEMPT, attempts

# Runs of an arm: parts of a brand in order of their key.
RUNS = """SELECT p_brand AS arm, p_partkey AS line, p_partkey AS attempt_id, p_partkey % 3 = 0 AS all_pass, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS metric, CASE WHEN p_partkey % 13 > 0 THEN CAST(p_size AS BIGINT) * 10 - 200 + p_partkey % 7 END AS worst,
 CASE p_partkey % 5 WHEN 0 THEN 'screened' WHEN 1 THEN 'refused' ELSE 'full' END AS state, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS BIGINT) END AS second, p_partkey % 2 AS n_inconclusive FROM part"""


def runs(v):
    return spark_sql(v, RUNS, "part")


@query(f"SELECT arm, line, metric, second FROM ({RUNS}) r WHERE all_pass ORDER BY metric NULLS LAST, second NULLS LAST, line LIMIT 10")
def f1_best_feasible(v):
    return search.best_feasible(runs(v), "metric", "second", 10).select("arm", "line", "metric", "second")


@query(f"SELECT arm, min(metric) AS lightest, arg_min(attempt_id, metric * 1000000 + line) AS attempt_id FROM ({RUNS}) r WHERE all_pass GROUP BY arm")
def f2_lightest_passing(v):
    return search.lightest_passing(runs(v), "metric", ["arm"])


@query("""WITH b AS (SELECT l_orderkey AS candidate, l_partkey % 20 AS requirement, min(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) AS seen, min(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END) AS mean, max(CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 4 AS DOUBLE) END) AS std FROM lineitem GROUP BY l_orderkey, l_partkey % 20),
m AS (SELECT candidate, coalesce(seen, mean) AS margin, CASE WHEN seen IS NOT NULL THEN 0.0 ELSE std END AS std, requirement FROM b)
SELECT candidate, w.margin + 0.5 * w.std AS score, w.requirement AS binding FROM (SELECT candidate, min({'margin': margin, 'std': std, 'requirement': requirement}) AS w FROM m GROUP BY candidate) x""")
def f3_rank_candidates(v):
    rows = v("lineitem").select(F.col("l_orderkey").alias("candidate"), (F.col("l_partkey") % 20).alias("requirement"), "l_quantity", (F.col("l_suppkey") % 4).cast("double").alias("std"), (F.col("l_linenumber") % 3 == 0).alias("seen"))
    observed = rows.filter("seen").groupBy("candidate", "requirement").agg(F.min("l_quantity").alias("margin"))
    predicted = rows.filter("not seen").groupBy("candidate", "requirement").agg(F.min("l_quantity").alias("mean"), F.max("std").alias("std"))
    return search.rank_candidates(v("orders").select(F.col("o_orderkey").alias("candidate")), observed, predicted, 0.5)


SWEEP = f"SELECT arm, line, all_pass, metric + line % 50 * 100 AS primary, second AS secondary FROM ({RUNS}) r WHERE line % 4 = 0"


@query(f"""WITH s AS ({SWEEP.replace(' AS primary', ' AS prim')}), o AS (SELECT arm, prim AS optimum FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY prim NULLS LAST, secondary NULLS LAST, line) AS n FROM s WHERE all_pass) x WHERE n = 1)
SELECT arm, optimum, min(place) FILTER (all_pass AND metric <= optimum) AS recovered_after FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY line) AS place FROM ({RUNS}) r) q JOIN o USING (arm) GROUP BY arm, optimum""")
def f4_recovery_check(v):
    r = runs(v)
    sweep = r.filter("line % 4 = 0").select("arm", "line", "all_pass", (F.col("metric") + F.col("line") % 50 * 100).alias("primary"), F.col("second").alias("secondary"))
    return search.recovery_check(search.sweep_optimum(sweep, ["arm"]), r, ["arm"])


@query("SELECT id, grp, x, y FROM f_front a WHERE NOT EXISTS (SELECT 1 FROM f_front b WHERE b.grp = a.grp AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))")
def c16_pareto_front(v):
    return search.pareto_front(v("f_front"), "x", "y", ["grp"])


@query("SELECT id, x, y, id % 97 AS z FROM f_front a WHERE NOT EXISTS (SELECT 1 FROM f_front b WHERE b.x <= a.x AND b.y <= a.y AND b.id % 97 <= a.id % 97 AND (b.x < a.x OR b.y < a.y OR b.id % 97 < a.id % 97))")
def c16_pareto_front_nd(v):
    return skyline.pareto_front_nd(v("f_front").select("id", "x", "y", (F.col("id") % 97).alias("z")), ["x", "y", "z"])


@query("""WITH m AS (SELECT DISTINCT p_brand AS material FROM part), a AS (SELECT unnest([1, 2, 3, 5]) AS n)
SELECT material AS first, NULL AS second, n AS a, 0 AS b, n AS total FROM m, a WHERE n BETWEEN 2 AND 6 UNION ALL SELECT m.material, k.material, a.n, b.n, a.n + b.n FROM m, m k, a, a b WHERE m.material <> k.material AND a.n + b.n BETWEEN 2 AND 6""")
def c17_enumerate_grid(v):
    return search.enumerate_grid(v("part").select(F.col("p_brand").alias("material")).distinct(), [1, 2, 3, 5], 6, 2)


@query(f"""WITH b AS (SELECT CAST(second AS VARCHAR) || '/' || CAST(metric % 7 AS VARCHAR) AS s FROM ({RUNS}) r WHERE all_pass AND second IS NOT NULL ORDER BY metric NULLS LAST, s LIMIT 1)
SELECT arm, min(n) FILTER (s = (SELECT s FROM b)) AS n_until FROM (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY line) AS n, CAST(second AS VARCHAR) || '/' || CAST(metric % 7 AS VARCHAR) AS s FROM ({RUNS}) r) q GROUP BY arm""")
def c18_match_optimum(v):
    r = runs(v).withColumn("signature", F.concat(F.col("second").cast("string"), F.lit("/"), (F.col("metric") % 7).cast("string")))
    return search.match_optimum(r.filter("second is not null").select("signature", "metric", "all_pass"), r.select("arm", "line", "signature"))


@query("""WITH q AS (SELECT conv_id * 1000 + turn AS call_id, turn * 10 AS asked FROM conversations WHERE role = 'user'), r AS (SELECT conv_id * 1000 + turn - 1 AS call_id, turn * 10 + length(text) % 9 AS at_ms, length(text) % 11 = 0 AS error FROM conversations WHERE role = 'assistant')
SELECT q.call_id, at_ms - asked AS wall_ms, error FROM q LEFT JOIN r ON r.call_id = q.call_id AND at_ms >= asked""")
def c19_pair_calls(v):
    c = v("conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    asked = c.filter("role = 'user'").select(key.alias("call_id"), F.lit("request").alias("kind"), (F.col("turn") * 10).alias("at_ms"), F.lit(False).alias("error"))
    answered = c.filter("role = 'assistant'").select((key - 1).alias("call_id"), F.lit("response").alias("kind"), (F.col("turn") * 10 + F.length("text") % 9).alias("at_ms"), (F.length("text") % 11 == 0).alias("error"))
    return search.pair_calls(asked.unionByName(answered))


@query("SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'idiot') THEN 'idiot' END, CASE WHEN contains(lower(text), 'clown') THEN 'clown' END, CASE WHEN contains(lower(text), 'the') THEN 'the' END) AS terms FROM conversations WHERE role = 'assistant' AND (contains(lower(text), 'idiot') OR contains(lower(text), 'clown') OR contains(lower(text), 'the'))")
def h18_scan_terms(v):
    return search.scan_terms(v("conversations").filter("role = 'assistant'"), ["Idiot", "clown", "the"]).select("conv_id", "turn", "terms")


@query("SELECT l_orderkey, string_agg(l_returnflag || ':' || CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey, l_returnflag) AS signature FROM lineitem GROUP BY l_orderkey")
def h17_design_signatures(v):
    items = v("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("amount"), F.col("l_returnflag").alias("item")))).alias("items"))
    return items.select("l_orderkey", search.design_signature().alias("signature"))


STATES = f"""SELECT arm, count(*) AS n_runs, count(*) FILTER (state = 'screened') AS n_screened, count(*) FILTER (state = 'full') AS n_full, count(*) FILTER (state = 'refused') AS n_refused, count(*) FILTER (all_pass) AS n_pass, min(metric) FILTER (all_pass) AS best, CAST(sum(n_inconclusive) AS BIGINT) AS n_inconclusive FROM ({RUNS}) r GROUP BY arm"""


@query(f"SELECT s.*, first_pass FROM ({STATES}) s JOIN (SELECT arm, min(n) FILTER (all_pass) AS first_pass FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY line) AS n FROM ({RUNS}) r) q GROUP BY arm) f USING (arm)")
def d15_campaign_summary(v):
    return search.campaign_summary(runs(v), ["arm"])


@query(f"""SELECT arm, count(*) FILTER (state = 'full') AS n_evaluated, bool_or(state = 'full' AND all_pass) AS success, min(nth) FILTER (state = 'full' AND all_pass) AS evaluations_to_pass, min(metric) FILTER (state = 'full' AND all_pass) AS lightest, count(*) FILTER (state = 'refused') AS n_refused, count(*) FILTER (state = 'screened') AS n_other
FROM (SELECT *, CAST(sum(CASE WHEN state = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY arm ORDER BY line) AS BIGINT) AS nth FROM ({RUNS}) r) q GROUP BY arm""")
def d16_trial_scores(v):
    return search.trial_scores(runs(v), ["arm"])


@query(f"""SELECT requirement_id, CASE WHEN u > l THEN 'upper' WHEN l > u THEN 'lower' END AS direction FROM (SELECT requirement_id, count(*) FILTER (margin = limit_minor - nominal) AS u, count(*) FILTER (margin = nominal - limit_minor) AS l FROM ({PER_ATTEMPT}) x JOIN f_requirements r USING (requirement_id) GROUP BY requirement_id) y""".replace("margin = limit_minor - nominal", "margin = r.limit_minor - nominal").replace("margin = nominal - limit_minor", "margin = nominal - r.limit_minor"))
def d17_infer_direction(v):
    rows = attempts(v).select("requirement_id", "margin", "nominal").join(v("f_requirements").select("requirement_id", F.col("limit_minor").alias("limit")), "requirement_id")
    return search.infer_direction(rows)


@query(f"""SELECT requirement_id, CASE WHEN requirement_id % 4 = 0 THEN 'kg' WHEN requirement_id % 4 = 1 THEN 'mm' ELSE 'cent' END AS unit, bool_or(rule LIKE 'bounded.%' OR rule LIKE 'enclosure.%' OR rule LIKE 'equal.%') AS ever_bounded, CASE WHEN requirement_id % 4 = 0 THEN 'mass' WHEN requirement_id % 4 = 1 THEN 'length' ELSE 'money' END AS role FROM ({PER_ATTEMPT}) x GROUP BY requirement_id""")
def d18_classify_requirements(v):
    k = F.col("requirement_id") % 4
    rows = attempts(v).select("requirement_id", F.col("attempt_id").alias("line"), F.when(k == 0, "kg").when(k == 1, "mm").otherwise("cent").alias("unit"), "rule")
    return search.classify_requirements(rows)


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, quantile_cont(l_quantity, 0.5) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY l_suppkey, l_returnflag")
def d19_duration_stats(v):
    stats = search.duration_stats(v("lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("duration_ms")), ["l_suppkey", "l_returnflag"])
    return stats.withColumn("p90", F.round("p90", 6))


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total, true AS p50_within, true AS p90_within FROM lineitem GROUP BY l_returnflag""")
def d19_duration_sketches(v):
    """Sketches kept by day, in two batches, merged; the share of values below each percentile is within the stated error."""
    rows = v("lineitem").select("l_returnflag", F.col("l_shipdate").cast("date").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("duration_ms"), "l_orderkey")
    batches = [search.sketch_durations(rows.filter(F.col("l_orderkey") % 2 == k), ["l_returnflag", "day"]) for k in (0, 1)]
    kept = materialize(batches[0].unionByName(batches[1]), "sketches")
    stats = search.sketched_stats(kept, ["l_returnflag"])
    both = rows.join(stats, "l_returnflag").groupBy("l_returnflag", "n", "total", "p50", "p90").agg(
        *[F.avg((F.col("duration_ms") < F.col(p)).cast("double")).alias(f"{p}_below") for p in ("p50", "p90")],
        *[F.avg((F.col("duration_ms") <= F.col(p)).cast("double")).alias(f"{p}_upto") for p in ("p50", "p90")])
    within = lambda p, q: (F.col(f"{p}_below") <= q + search.RANK_ERROR) & (F.col(f"{p}_upto") >= q - search.RANK_ERROR)
    return both.select("l_returnflag", "n", "total", within("p50", 0.5).alias("p50_within"), within("p90", 0.9).alias("p90_within"))


# The fold once more, row by row: a recursive walk along each arm.
E4 = f"""WITH RECURSIVE o AS (SELECT arm, line, worst, state, row_number() OVER (PARTITION BY arm ORDER BY line) AS n FROM ({RUNS}) r),
w(arm, line, n, best, last) AS (SELECT arm, line, n, worst, CASE WHEN worst IS NOT NULL THEN n ELSE 0 END FROM o WHERE n = 1
UNION ALL SELECT o.arm, o.line, o.n, CASE WHEN o.worst IS NOT NULL AND (w.best IS NULL OR o.worst > w.best + 15) THEN o.worst ELSE w.best END, CASE WHEN o.worst IS NOT NULL AND (w.best IS NULL OR o.worst > w.best + 15) THEN o.n ELSE w.last END FROM w JOIN o ON o.arm = w.arm AND o.n = w.n + 1)"""


@query(f"{E4} SELECT arm, line, best, CAST(n - last AS BIGINT) AS since FROM w")
def e4_best_so_far(v):
    return search.best_so_far(runs(v), ["arm"], "worst", 15).withColumn("since", F.col("since").cast("long"))


@query(f"{E4}, f AS (SELECT arm, line, sum(CASE WHEN state = 'full' THEN 1 ELSE 0 END) OVER (PARTITION BY arm ORDER BY line) AS n_full FROM o) SELECT arm, line, CASE WHEN n_full = 0 THEN n - last >= 2 ELSE n - last >= 8 END AS stop FROM w JOIN f USING (arm, line)")
def e5_patience_exhausted(v):
    r = runs(v)
    since = search.best_so_far(r, ["arm"], "worst", 15)
    return search.patience_exhausted(r.select("arm", "line", (F.col("state") == "full").alias("full")).join(since, ["arm", "line"]), ["arm"], 2, 8)


@query(f"""SELECT arm, coalesce(min(line) FILTER (state = 'refused') < max(line) FILTER (state = 'full' AND all_pass), false) AS recovered, arg_max(CASE WHEN state = 'refused' THEN 'refused' WHEN all_pass THEN 'pass' ELSE 'other' END, line) AS last_class FROM ({RUNS}) r GROUP BY arm""")
def e6_refused_then_recovered(v):
    return search.refused_then_recovered(runs(v), ["arm"])


@query("""WITH s AS (SELECT l_orderkey, bool_and(l_returnflag IN ('A', 'R')) AS screened FROM lineitem GROUP BY l_orderkey) SELECT o_custkey AS arm, o_orderkey AS line, CASE WHEN screened THEN 'screened' ELSE 'full' END AS kind, row_number() OVER (PARTITION BY o_custkey, screened ORDER BY o_orderkey) AS number FROM orders JOIN s ON l_orderkey = o_orderkey""")
def e10_running_screens(v):
    steps = v("lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.when(F.col("l_returnflag") == "A", "reused").when(F.col("l_returnflag") == "R", "skipped").otherwise("admitted").alias("state"))
    return search.running_screens(v("orders").select(F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("arm"), F.col("o_orderkey").alias("line")), steps)


@query(f"""SELECT attempt_id, requirement_id, CASE WHEN rule LIKE 'nominal.%' THEN 'nominal' WHEN rule LIKE 'bounded.%' OR rule LIKE 'enclosure.%' OR rule LIKE 'equal.%' THEN 'bounded' END AS basis_of_rule, CASE WHEN attempt_id % 3 = 0 THEN 'dose_rate' WHEN attempt_id % 3 = 1 THEN 'length' END AS role FROM ({PER_ATTEMPT}) x""")
def b10_rule_basis(v):
    k = F.col("attempt_id") % 3
    unit = F.when(k == 0, "uSv/h").when(k == 1, "cm").otherwise("?")
    return attempts(v).select("attempt_id", "requirement_id", search.rule_basis(F.col("rule")).alias("basis_of_rule"), search.unit_role(unit).alias("role"))


@query("""SELECT l_orderkey AS candidate, round(max(CASE WHEN l_linenumber = 1 THEN ln(l_extendedprice) END), 9) AS y_1, round(max(CASE WHEN l_linenumber = 2 THEN ln(l_extendedprice) END), 9) AS y_2 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def k1_feature_table(v):
    verdicts = v("lineitem").groupBy(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").cast("string").alias("requirement")).agg(F.max("l_extendedprice").alias("nominal"))
    candidates = verdicts.select("candidate").distinct().join(v("orders").select(F.col("o_orderkey").alias("candidate")), "candidate")
    out = surrogate.feature_table(candidates, verdicts, ["1", "2"])
    return out.select("candidate", *[F.round(c, 9).alias(c) for c in ("y_1", "y_2")])


FEATURES = ["l_quantity", "l_discount", "l_tax"]
RESAMPLES = 16
#: A draw of a line for a resample by integer arithmetic, which SQL writes alike.
DRAW = "((((l_orderkey * 10 + l_linenumber) % 1000003 * 7919 + resample * 104729) * 48271 % 2147483647 * 16807 % 2147483647) + 0.5) / 2147483647.0"


def _samples(v):
    return v("lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").cast("string").alias("requirement"), *FEATURES, F.ln("l_extendedprice").alias("y"))


def _models(v):
    return surrogate.ridge_by_requirement(_samples(v), FEATURES, "y", ["requirement"], 1.0)


def _ridge_sql(rows: str, by: str, name: str) -> str:
    """The regressions of ``rows(by, w, x1, x2, x3, y)`` as CTEs that end in ``name(by, n, intercept, c1..c3, m1..m3, d1..d3)``, solved by determinants."""
    x = ["1", "x1", "x2", "x3", "y"]
    sums = ", ".join(f"sum(w * {x[i]} * {x[j]}) AS s{i}{j}" for i in range(5) for j in range(i, 5))
    means = ", ".join(f"s0{i} / s00 AS m{i}" for i in (1, 2, 3))
    scales = ", ".join(f"CASE WHEN sqrt(greatest(s{i}{i} / s00 - m{i} * m{i}, 0)) > 1e-9 THEN sqrt(greatest(s{i}{i} / s00 - m{i} * m{i}, 0)) ELSE 1.0 END AS d{i}" for i in (1, 2, 3))
    system = ", ".join(f"(s{i}{j} / s00 - m{i} * m{j}) / (d{i} * d{j}) * s00 + {1.0 if i == j else 0.0} AS a{i}{j}" for i in (1, 2, 3) for j in range(i, 4))
    right = ", ".join(f"(s{i}4 / s00 - m{i} * s04 / s00) / d{i} * s00 AS b{i}" for i in (1, 2, 3))

    def det(a, b, c):  # columns of three
        return " + ".join(f"{a[i]} * ({b[j]} * {c[k]} - {b[k]} * {c[j]})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    columns = [[f"a{min(i, j)}{max(i, j)}" for i in (1, 2, 3)] for j in (1, 2, 3)]
    solved = ", ".join(f"({det(*[['b1', 'b2', 'b3'] if k == j else columns[k] for k in range(3)])}) / ({det(*columns)}) AS c{j + 1}" for j in range(3))
    return f"""{name}_g AS (SELECT {by}, count(*) AS n, {sums} FROM {rows} GROUP BY {by}), {name}_m AS (SELECT *, {means} FROM {name}_g WHERE n >= 5 AND s00 > 0), {name}_d AS (SELECT *, {scales} FROM {name}_m), {name}_a AS (SELECT *, {system}, {right} FROM {name}_d),
{name} AS (SELECT {by}, n, s04 / s00 AS intercept, {solved}, m1, m2, m3, d1, d2, d3 FROM {name}_a)"""


LINES = "SELECT l_orderkey, l_linenumber, l_orderkey AS candidate, CAST(l_linenumber AS VARCHAR) AS requirement, l_quantity AS x1, l_discount AS x2, l_tax AS x3, ln(l_extendedprice) AS y FROM lineitem"
POINT = f"WITH l AS ({LINES}), p AS (SELECT *, 1.0 AS w FROM l), {_ridge_sql('p', 'requirement', 'm')}"
BY_FEATURE = " UNION ALL ".join(f"SELECT *, '{f}' AS feature, c{i} AS coef, m{i} AS mean, d{i} AS scale FROM m" for i, f in enumerate(FEATURES, 1))


@query(f"{POINT} SELECT requirement, n, round(intercept, 6) AS intercept, feature, round(coef, 6) AS coef, round(mean, 6) AS mean, round(scale, 6) AS scale FROM ({BY_FEATURE}) f")
def k2_ridge_by_requirement(v):
    named = F.array(*map(F.lit, FEATURES)).alias("feature")
    rows = _models(v).select("requirement", "n", "intercept", F.inline(F.arrays_zip(named, "coef", "mean", "scale")))
    return rows.withColumns({c: F.round(c, 6) for c in ("intercept", "coef", "mean", "scale")})


def _spread(v):
    resampled = surrogate.bootstrap_models(_samples(v), "candidate", FEATURES, "y", ["requirement"], RESAMPLES, draw=F.expr(DRAW.replace("2147483647.0", "2147483647.0D").replace("0.5", "0.5D")))
    return surrogate.bootstrap_spread(_samples(v), _models(v), resampled, FEATURES)


def _value(m: str) -> str:
    return f"{m}.intercept + " + " + ".join(f"(x{i} - {m}.m{i}) / {m}.d{i} * {m}.c{i}" for i in (1, 2, 3))


COUNT = " + ".join(f"CASE WHEN u > {t!r}::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for t in surrogate.poisson_thresholds())
#: Every line's prediction by the model and, one resample after the other, their standard deviation.
SPREAD = f"""{POINT}, e AS (SELECT *, {DRAW.replace('0.5', '0.5::DOUBLE').replace('2147483647.0', '2147483647.0::DOUBLE')} AS u FROM l, (SELECT unnest(range(1, {RESAMPLES + 1})) AS resample) r), q AS (SELECT *, {COUNT} AS w FROM e), {_ridge_sql('q', 'requirement, resample', 'b')},
v AS (SELECT row_number() OVER () AS row_id, * FROM l), t AS (SELECT row_id, stddev_pop({_value('b')}) AS std FROM v JOIN b USING (requirement) GROUP BY row_id),
spread AS (SELECT v.candidate, v.requirement, {_value('m')} AS mean_log, t.std FROM v JOIN m USING (requirement) JOIN t USING (row_id))"""


@query(f"{SPREAD} SELECT candidate, requirement, round(mean_log, 4) AS mean_log, round(std, 4) AS std FROM spread")
def k3_bootstrap_spread(v):
    return _spread(v).withColumns({c: F.round(c, 4) for c in ("mean_log", "std")})


@query(f"""{SPREAD}, g AS (SELECT candidate, requirement, CASE WHEN CAST(requirement AS INT) % 2 = 0 THEN 40000.0 - exp(mean_log) ELSE exp(mean_log) - 40000.0 END AS margin, exp(mean_log) * std AS std FROM spread)
SELECT candidate, round(w.margin + 0.5 * w.std, 2) AS score, w.requirement AS binding FROM (SELECT candidate, min({{'margin': margin, 'std': std, 'requirement': requirement}}) AS w FROM g GROUP BY candidate) x""")
def k4_score_pool(v):
    direction = F.when(F.col("requirement").cast("int") % 2 == 0, "upper").otherwise("lower")
    specs = v("lineitem").select(F.col("l_linenumber").cast("string").alias("requirement")).distinct().withColumns({"limit": F.lit(40_000.0), "direction": direction})
    return surrogate.score_pool(surrogate.predict_margins(_spread(v), specs), 0.5).withColumn("score", F.round("score", 2))


@query(f"{POINT} SELECT requirement, feature, round(coef / scale, 6) AS slope FROM ({BY_FEATURE}) f")
def k5_sensitivity(v):
    return surrogate.sensitivity(_models(v), FEATURES, ["requirement"]).withColumn("slope", F.round("slope", 6))
