"""The decision table, exhaustively on small integers, against a plain loop."""

import itertools

from pyspark.sql import functions as F

from assayer.operators import verdicts

COMPARISONS = list(verdicts.TOKENS)
REQ = "requirement_id long, comparison string, basis string, required_coverage double, limit_minor long, tolerance_minor long, permit_nominal boolean"
CLAIM = "requirement_id long, claim_id long, ordinal int, model string, state string, lower_minor long, upper_minor long, nominal_minor long, coverage double"


def satisfied(comparison, value):
    return {"less_than": value < 0, "less_than_or_equal": value <= 0, "greater_than": value > 0, "greater_than_or_equal": value >= 0}[comparison]


def expected(comparison, basis, low, high):
    if comparison == "equal":
        if low is not None and high is not None and -1 <= low and high <= 1:
            return "pass", "equal.within"
        if (low is not None and low > 1) or (high is not None and high < -1):
            return "fail", "equal.outside"
        return "inconclusive", "equal.partial"
    token = verdicts.TOKENS[comparison]
    good, bad, miss = (high, low, "exceeds") if token in ("lt", "le") else (low, high, "below")
    if good is not None and satisfied(comparison, good):
        return "pass", f"{basis}.{token}.within"
    if bad is not None and not satisfied(comparison, bad):
        return "fail", f"{basis}.{token}.{miss}"
    kind = "crossing" if low is not None and high is not None else "upper_only" if high is not None else "lower_only"
    return "inconclusive", f"{basis}.{token}.{kind}"


def test_all_small_intervals(spark):
    reqs, claims, want = [], [], {}
    bounds = [None, *range(-3, 4)]
    for comparison, basis, low, high in itertools.product(COMPARISONS, ("bounded", "enclosure"), bounds, bounds):
        if (low is None and high is None) or (low is not None and high is not None and low > high):
            continue
        k = len(reqs)
        reqs.append((k, comparison, basis, None, 0, 1 if comparison == "equal" else None, False))
        claims.append((k, k, 1, "interval" if low is not None and high is not None else "worst_case", "admitted", low, high, None, None))
        want[k] = expected(comparison, basis, low, high)
    out = verdicts.evaluate_verdicts(spark.createDataFrame(reqs, REQ), spark.createDataFrame(claims, CLAIM), ["requirement_id"])
    assert {r.requirement_id: (r.status, r.rule) for r in out.collect()} == want


def one(spark, requirement, claims):
    row = {"comparison": "less_than", "basis": "bounded", "required_coverage": None, "limit_minor": 10, "tolerance_minor": None, "permit_nominal": True, **requirement}
    reqs = spark.createDataFrame([(1, *[row[c.split()[0]] for c in REQ.split(", ")[1:]])], REQ)
    base = {"ordinal": 1, "model": "exact", "state": "admitted", "lower_minor": None, "upper_minor": None, "nominal_minor": None, "coverage": None}
    rows = [(1, i, *[{**base, **c}[n] for n in base]) for i, c in enumerate(claims)]
    mode = row.get("mode")
    given = spark.createDataFrame([(i, c.get("instance_id", str(i))) for i, c in enumerate(claims)], "claim_id long, instance_id string")
    bound = spark.createDataFrame(rows, CLAIM).join(given, "claim_id")
    out = verdicts.evaluate_verdicts(reqs, bound, ["requirement_id"], None, F.lit(mode) if mode else None)
    r = out.first()
    return r.rule.removeprefix("not_evaluated."), r.refusal, r.margin


def test_gates_come_in_order(spark):
    exact = {"nominal_minor": 3}
    assert one(spark, {}, [])[0] == "missing"
    assert one(spark, {}, [{"ordinal": 2, "state": "quarantined", **exact}, {"ordinal": 1, "state": "invalidated", **exact}])[0] == "invalidated"
    assert one(spark, {}, [exact, exact])[0] == "duplicate_claim"
    wide = {"model": "coverage_interval", "lower_minor": 1, "upper_minor": 5, "nominal_minor": 3, "coverage": 0.9}
    assert one(spark, {"mode": "max"}, [wide, wide])[0] == "coverage_aggregation_requires_capability"
    assert one(spark, {}, [exact]) == ("bounded.lt.within", None, 7)


def test_refusals_say_why(spark):
    exact = {"nominal_minor": 3}
    cases = [
        ({}, {"model": "interval", "lower_minor": 5, "upper_minor": 1}, "lower_above_upper"),
        ({}, {"model": "interval", "lower_minor": 1, "upper_minor": 2, "nominal_minor": 7}, "nominal_outside"),
        ({}, {"model": "worst_case", "lower_minor": 1, "upper_minor": 2}, "claim_shape"),
        ({"required_coverage": 0.95}, {"model": "coverage_interval", "lower_minor": 1, "upper_minor": 5, "nominal_minor": 3, "coverage": 0.9}, "coverage_below_required"),
        ({}, {"model": "coverage_interval", "lower_minor": 1, "upper_minor": 5, "nominal_minor": 3, "coverage": 1.5}, "coverage_range"),
        ({"tolerance_minor": -1}, exact, "negative_tolerance"),
        ({"basis": "nominal", "permit_nominal": False}, exact, "nominal_not_permitted"),
        ({"basis": "nominal"}, {"model": "interval", "lower_minor": 1, "upper_minor": 2}, "no_nominal"),
        ({"comparison": "equal"}, exact, "equality_without_tolerance"),
        ({}, {"model": "unquantified", "nominal_minor": 3}, "no_bound"),
    ]
    for requirement, claim, why in cases:
        assert one(spark, requirement, [claim])[:2] == ("kernel_refusal", why)


def test_aggregated_claims_need_instances_of_their_own(spark):
    one_, two = {"nominal_minor": 3, "instance_id": "a"}, {"nominal_minor": 5, "instance_id": "b"}
    assert one(spark, {"mode": "max"}, [one_, two]) == ("bounded.lt.within", None, 5)
    assert one(spark, {"mode": "min"}, [one_, one_])[:2] == ("kernel_refusal", "duplicate_instance")
    assert one(spark, {"mode": "max"}, [one_, {**two, "instance_id": None}])[:2] == ("kernel_refusal", "instance_missing")
    assert one(spark, {}, [{**one_, "instance_id": None}]) == ("bounded.lt.within", None, 7)


def test_nominal_verdicts_state_no_bounds(spark):
    reqs = spark.createDataFrame([(1, "less_than", "nominal", None, 10, None, True), (2, "less_than", "bounded", None, 10, None, True)], REQ)
    claims = spark.createDataFrame([(r, r, 1, "coverage_interval", "admitted", 1, 5, 3, 0.9) for r in (1, 2)], CLAIM)
    rows = {r.requirement_id: (r.lower, r.upper, r.nominal, r.margin) for r in verdicts.evaluate_verdicts(reqs, claims, ["requirement_id"]).collect()}
    assert rows == {1: (None, None, 3, 7), 2: (1, 5, 3, 5)}


def test_statuses_in_pairs(spark):
    statuses = verdicts.ALL_ORDER
    rows = [(i * 4 + j, s) for i, a in enumerate(statuses) for j, b in enumerate(statuses) for s in (a, b)]
    df = spark.createDataFrame(rows, "g int, status string")
    for mode, order in (("all", verdicts.ALL_ORDER), ("any", verdicts.ANY_ORDER)):
        got = {r.g: r.status for r in verdicts.aggregate_verdicts(df, ["g"], mode).collect()}
        assert got == {i * 4 + j: min((a, b), key=order.index) for i, a in enumerate(statuses) for j, b in enumerate(statuses)}
