"""Verdicts: claims against requirements, in exact integers of a canonical unit.

Requirements: ``requirement_id, comparison, basis, required_coverage, limit_minor, tolerance_minor,
permit_nominal``, and ``aggregation`` (max, min or null) if claims may be reduced.  Claims:
``claim_id, ordinal, model, state, lower_minor, upper_minor, nominal_minor, coverage``, the columns that
they are grouped by, and ``instance_id`` if they are aggregated: every claim needs one of its own.  Rules of the decision table are ``Column`` expressions over one grouped row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.units import violations

# How comparisons are named in rules.
TOKENS = {"less_than": "lt", "less_than_or_equal": "le", "greater_than": "gt", "greater_than_or_equal": "ge", "equal": "equal"}
UPPER_LIMITS = ("less_than", "less_than_or_equal")
#: From worst to best under ``all``, and under ``any``.
ALL_ORDER = ("fail", "not_evaluated", "inconclusive", "pass")
ANY_ORDER = ("pass", "not_evaluated", "inconclusive", "fail")


def _shape_ok() -> Column:
    lower, upper, nominal, coverage = (F.col(c).isNotNull() for c in ("lower_minor", "upper_minor", "nominal_minor", "coverage"))
    return (
        F.when(F.col("model").isin("exact", "unquantified"), nominal & ~lower & ~upper & ~coverage)
        .when(F.col("model") == "interval", lower & upper & ~coverage)
        .when(F.col("model") == "coverage_interval", lower & upper & nominal & coverage)
        .when(F.col("model") == "worst_case", lower != upper)
        .otherwise(False)
    )


def claim_problem() -> Column:
    """Why a claim with its requirement's ``required_coverage`` is refused; null if it is not."""
    low, high, nominal = F.col("lower_minor"), F.col("upper_minor"), F.col("nominal_minor")
    return (
        F.when(~_shape_ok(), "claim_shape")
        .when(low > high, "lower_above_upper")
        .when((nominal < low) | (nominal > high), "nominal_outside")
        .when((F.col("coverage") <= 0) | (F.col("coverage") > 1), "coverage_range")
        .when(F.col("coverage").isNotNull() & ((F.col("required_coverage") <= 0) | (F.col("required_coverage") > 1)), "coverage_range")
        .when(F.col("coverage") < F.col("required_coverage"), "coverage_below_required")
    )


def bind_claims(requirements: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Requirements with their claims; those without stay, with null claim columns."""
    return requirements.join(claims, keys, "left")


#: What the claims of a group add up to: columns of :func:`claim_sums` that :func:`merge_sums` puts together, and more under an aggregation.
SUMS = ("n_claims", "open_state", "__open_at", "any_coverage", "claim_problem", "__problem_at", "__low_max", "__high_max", "__nominal")
MORE_SUMS = ("mode", "__instances", "n_nameless", "__low_min", "__low_count", "__high_min", "__high_count")


def claim_sums(bound: DataFrame, keys: list[str], aggregation: Column | None = None) -> DataFrame:
    """``keys`` and :data:`SUMS` for each group of claims, with an aggregation :data:`MORE_SUMS` too."""
    exact = F.col("model") == "exact"
    low, high = (F.when(exact, F.col("nominal_minor")).otherwise(F.col(c)) for c in ("lower_minor", "upper_minor"))
    rows = bound.withColumns({"__low": low, "__high": high, "__problem": claim_problem()})
    claim = F.col("claim_id").isNotNull()
    open_state = F.when(claim & (F.col("state") != "admitted"), F.col("state"))
    open_at, problem_at = (F.when(c.isNotNull(), F.col("ordinal")) for c in (open_state, F.col("__problem")))
    more = []
    if aggregation is not None:  # of instances a set, not a distinct count, so that parts can be put together
        rows = rows.withColumn("__mode", aggregation)
        more = [F.max("__mode").alias("mode"), F.collect_set("instance_id").alias("__instances"), F.count_if(claim & F.col("instance_id").isNull()).alias("n_nameless")]
        more += [f(c).alias(f"{c}_{f.__name__}") for c in ("__low", "__high") for f in (F.min, F.count)]
    return rows.groupBy(*keys).agg(
        F.count("claim_id").alias("n_claims"),
        F.min_by(open_state, open_at).alias("open_state"),
        F.min(open_at).alias("__open_at"),
        F.bool_or(claim & (F.col("model") == "coverage_interval")).alias("any_coverage"),
        F.min_by("__problem", problem_at).alias("claim_problem"),
        F.min(problem_at).alias("__problem_at"),
        F.max("__low").alias("__low_max"),
        F.max("__high").alias("__high_max"),
        F.max("nominal_minor").alias("__nominal"),
        *more,
    )


def merge_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`claim_sums` of all claims from those of parts of them."""
    more = []
    if "mode" in parts.columns:
        more = [F.max("mode").alias("mode"), F.array_distinct(F.flatten(F.collect_list("__instances"))).alias("__instances")]
        more += [F.sum(c).alias(c) for c in ("n_nameless", "__low_count", "__high_count")] + [F.min(c).alias(c) for c in ("__low_min", "__high_min")]
    return parts.groupBy(*keys).agg(
        F.sum("n_claims").alias("n_claims"),
        *[F.min_by(c, at).alias(c) for c, at in (("open_state", "__open_at"), ("claim_problem", "__problem_at"))],
        *[F.min(at).alias(at) for at in ("__open_at", "__problem_at")],
        F.bool_or("any_coverage").alias("any_coverage"),
        *[F.max(c).alias(c) for c in ("__low_max", "__high_max", "__nominal")],
        *more,
    )


def reduce_claims(bound: DataFrame, keys: list[str], aggregation: Column | None = None) -> DataFrame:
    """One row per group: what the gates and the decision table look at."""
    return reduced(claim_sums(bound, keys, aggregation), keys)


def reduced(sums: DataFrame, keys: list[str]) -> DataFrame:
    """What :func:`decide` looks at, from :func:`claim_sums`.

    Under ``max`` the upper bound counts only if every claim has one, under ``min`` the lower one.
    """
    mode, lower, upper = F.lit(None).cast("string"), F.col("__low_max"), F.col("__high_max")
    n_instances = n_nameless = F.lit(None).cast("long")
    if "mode" in sums.columns:
        mode, n_instances, n_nameless = F.col("mode"), F.size("__instances").cast("long"), F.col("n_nameless")
        every_low, every_high = (F.col(f"{c}_count") == F.col("n_claims") for c in ("__low", "__high"))
        lower = F.when(mode == "min", F.when(every_low, F.col("__low_min"))).otherwise(lower)
        upper = F.when(mode == "max", F.when(every_high, upper)).when(mode == "min", F.col("__high_min")).otherwise(upper)
    return sums.select(*keys, "n_claims", n_instances.alias("n_instances"), n_nameless.alias("n_nameless"), "open_state", "any_coverage", "claim_problem", mode.alias("mode"), lower.alias("lower"), upper.alias("upper"), F.when(mode.isNull(), F.col("__nominal")).alias("nominal"))


def _satisfies(value: Column) -> Column:
    limit, c = F.col("limit_minor"), F.col("comparison")
    return F.when(c == "less_than", value < limit).when(c == "less_than_or_equal", value <= limit).when(c == "greater_than", value > limit).otherwise(value >= limit)


def decide(reduced: DataFrame) -> DataFrame:
    """Add ``status, rule, refusal, margin`` to rows that have the requirement's columns and a reduced claim."""
    low, high, nominal = F.col("lower"), F.col("upper"), F.col("nominal")
    equal, is_nominal = F.col("comparison") == "equal", F.col("basis") == "nominal"
    tolerance = F.col("tolerance_minor")
    bottom, top = F.col("limit_minor") - tolerance, F.col("limit_minor") + tolerance
    refusal = (
        F.when(F.col("claim_problem").isNotNull(), F.col("claim_problem"))
        .when(F.col("mode").isNotNull() & (F.col("n_nameless") > 0), "instance_missing")
        .when(F.col("mode").isNotNull() & (F.col("n_instances") != F.col("n_claims")), "duplicate_instance")
        .when(tolerance < 0, "negative_tolerance")
        .when(is_nominal & ~F.coalesce(F.col("permit_nominal"), F.lit(False)), "nominal_not_permitted")
        .when(is_nominal & nominal.isNull(), "no_nominal")
        .when(equal & tolerance.isNull(), "equality_without_tolerance")
        .when(~is_nominal & ~equal & low.isNull() & high.isNull(), "no_bound")
    )
    gate = (
        F.when(F.col("n_claims") == 0, "not_evaluated.missing")
        .when(F.col("open_state").isNotNull(), F.concat(F.lit("not_evaluated."), "open_state"))
        .when((F.col("n_claims") > 1) & F.col("mode").isNull(), "not_evaluated.duplicate_claim")
        .when((F.col("n_claims") > 1) & (F.col("basis") == "bounded") & F.col("any_coverage"), "not_evaluated.coverage_aggregation_requires_capability")
        .when(refusal.isNotNull(), "not_evaluated.kernel_refusal")
    )
    is_upper = F.col("comparison").isin(*UPPER_LIMITS)
    token = reduce(lambda c, kv: c.when(F.col("comparison") == kv[0], kv[1]), list(TOKENS.items())[1:], F.when(F.col("comparison") == "less_than", "lt"))
    good, bad = F.when(is_upper, high).otherwise(low), F.when(is_upper, low).otherwise(high)
    miss = F.when(is_upper, "exceeds").otherwise("below")
    crossing = F.when(low.isNotNull() & high.isNotNull(), "crossing").when(high.isNotNull(), "upper_only").otherwise("lower_only")
    ends = F.when(F.coalesce(_satisfies(good), F.lit(False)), "within").when(bad.isNotNull() & ~_satisfies(bad), miss).otherwise(crossing)
    inside = F.coalesce((low >= bottom) & (high <= top), F.lit(False))
    outside = F.coalesce(low > top, F.lit(False)) | F.coalesce(high < bottom, F.lit(False))
    rule = (
        F.when(is_nominal & equal, F.concat(F.lit("nominal.equal."), F.when((nominal >= bottom) & (nominal <= top), "within").otherwise("outside")))
        .when(is_nominal, F.concat(F.lit("nominal."), token, F.lit("."), F.when(_satisfies(nominal), "within").otherwise(miss)))
        .when(equal, F.concat(F.lit("equal."), F.when(inside, "within").when(outside, "outside").otherwise("partial")))
        .otherwise(F.concat(F.col("basis"), F.lit("."), token, F.lit("."), ends))
    )
    last = F.substring_index(F.col("rule"), ".", -1)
    status = F.when(F.col("rule").startswith("not_evaluated"), "not_evaluated").when(last == "within", "pass").when(last.isin("exceeds", "below", "outside"), "fail").otherwise("inconclusive")
    done = reduced.withColumn("refusal", F.when(gate == "not_evaluated.kernel_refusal", refusal)).withColumn("rule", F.coalesce(gate, rule))
    done = done.withColumn("status", status).withColumn("margin", F.when(F.col("status") != "not_evaluated", margin()))
    # A nominal verdict used no bounds, so it states none.
    return done.withColumns({c: F.when(~is_nominal, F.col(c)) for c in ("lower", "upper")})


def margin() -> Column:
    """Signed distance to the limit from the decisive bound, positive inside; none for equality."""
    nominal = F.col("basis") == "nominal"
    upper, lower = F.when(nominal, F.col("nominal")).otherwise(F.col("upper")), F.when(nominal, F.col("nominal")).otherwise(F.col("lower"))
    limit = F.col("limit_minor")
    return F.when(F.col("comparison").isin(*UPPER_LIMITS), limit - upper).when(F.col("comparison") != "equal", lower - limit)


def evaluate_verdicts(requirements: DataFrame, claims: DataFrame, keys: list[str], per: list[str] | None = None, aggregation: Column | None = None) -> DataFrame:
    """A verdict for each requirement, or for each requirement and ``per`` (such as an attempt) that has claims.

    ``keys`` bind claims to requirements.  With ``aggregation`` (``max`` or ``min`` by row) several claims reduce to one.
    """
    return decide(reduced_claims(requirements, claims, keys, per, aggregation))


def reduced_claims(requirements: DataFrame, claims: DataFrame, keys: list[str], per: list[str] | None = None, aggregation: Column | None = None) -> DataFrame:
    """What :func:`decide` looks at: groups of claims with their requirement's columns, from one join and one grouping.

    Rows dealt by ``keys`` for the join are dealt well for the grouping too.
    """
    bound = claims.filter("claim_id is not null").join(requirements, keys) if per else bind_claims(requirements, claims, keys)
    return reduce_claims(bound, [*requirements.columns, *(per or [])], aggregation)


def check_requirements(requirements: DataFrame) -> DataFrame:
    """``requirement_id, problem``: coverage off a bounded basis or out of range, tolerances where they do not belong."""
    equal = F.col("comparison") == "equal"
    return violations(requirements, ["requirement_id"], {
        "coverage_needs_bounded_basis": F.col("required_coverage").isNotNull() & (F.col("basis") != "bounded"),
        "coverage_range": (F.col("required_coverage") <= 0) | (F.col("required_coverage") > 1),
        "equality_without_tolerance": equal & F.col("tolerance_minor").isNull(),
        "tolerance_without_equality": ~equal & F.col("tolerance_minor").isNotNull(),
        "negative_tolerance": F.col("tolerance_minor") < 0,
    })


def aggregate_verdicts(verdicts: DataFrame, by: list[str], mode: str = "all") -> DataFrame:
    """``by, status``: the verdict of all, or of any, of a group's verdicts."""
    return verdicts.groupBy(*by).agg(aggregated(mode).alias("status"))


def aggregated(mode: str) -> Column:
    """The aggregate of a group's statuses under ``all`` or ``any``."""
    order = F.array(*map(F.lit, ALL_ORDER if mode == "all" else ANY_ORDER))
    return F.element_at(order, F.min(F.array_position(order, F.col("status"))).cast("int"))


def assess_completion(verdicts: DataFrame, by: list[str], permitted_rules: list[str]) -> DataFrame:
    """``by, n, n_fulfilling, complete``: inconclusive counts only under a permitted rule, not evaluated never."""
    fulfils = F.col("status").isin("pass", "fail") | ((F.col("status") == "inconclusive") & F.col("rule").isin(*permitted_rules))
    return verdicts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(fulfils).alias("n_fulfilling"), F.bool_and(fulfils).alias("complete"))


def status_histogram(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each of the four statuses per group."""
    return verdicts.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in sorted(ALL_ORDER)])


def worst_margin(verdicts: DataFrame, run: list[str]) -> DataFrame:
    """``run, worst, binding``: the least margin of a run and the requirement that has it (least id of ties)."""
    least = F.min(F.when(F.col("margin").isNotNull(), F.struct("margin", "requirement_id")))
    return verdicts.groupBy(*run).agg(least.alias("m")).select(*run, F.col("m.margin").alias("worst"), F.col("m.requirement_id").alias("binding"))


def binding_counts(verdicts: DataFrame, run: list[str], tolerance: int = 0) -> DataFrame:
    """``requirement_id, n_binding``: how often a requirement is within ``tolerance`` of its run's worst margin."""
    worst = F.min("margin").over(Window.partitionBy(*run))  # so that verdicts are computed once
    near = verdicts.withColumn("worst", worst).filter(F.col("margin") <= F.col("worst") + tolerance)
    return near.groupBy("requirement_id").agg(F.count(F.lit(1)).alias("n_binding"))


def model_satisfies_basis(rows: DataFrame) -> DataFrame:
    """``rows(basis, comparison, model, has_lower, has_upper, has_nominal)`` with ``satisfies``."""
    upper = F.col("comparison").isin(*UPPER_LIMITS)
    side = F.when(F.col("comparison") == "equal", False).when(upper, F.col("has_upper")).otherwise(F.col("has_lower"))
    ok = (
        F.when(F.col("basis") == "bounded", F.col("model").isin("exact", "interval", "coverage_interval") | ((F.col("model") == "worst_case") & side))
        .when(F.col("basis") == "enclosure", F.col("model").isin("exact", "interval"))
        .when(F.col("basis") == "nominal", F.col("has_nominal"))
        .otherwise(False)
    )
    return rows.withColumn("satisfies", ok)


def categorical_match(requirements: DataFrame, claims: DataFrame, key: str = "requirement_id") -> DataFrame:
    """Verdicts of ``requirements(key, comparison, accepted)`` over ``claims(key, claim_id, ordinal, state, value)``."""
    grouped = requirements.join(claims, key, "left").groupBy(key).agg(
        F.count("claim_id").alias("n_claims"),
        F.min_by(F.when(F.col("state") != "admitted", F.col("state")), F.when(F.col("state") != "admitted", F.col("ordinal"))).alias("open_state"),
        F.max("value").alias("value"),
    )
    accepted = F.col("accepted")
    bad = (F.size(accepted) == 0) | ((F.col("comparison") == "equals") & (F.size(accepted) != 1)) | F.exists(accepted, lambda v: F.trim(v) == "") | (F.size(F.array_distinct(accepted)) != F.size(accepted))
    hit = F.array_contains(accepted, F.col("value"))
    rule = (
        F.when(bad, "not_evaluated.kernel_refusal")
        .when(F.col("n_claims") == 0, "not_evaluated.missing")
        .when(F.col("open_state").isNotNull(), F.concat(F.lit("not_evaluated."), "open_state"))
        .when(F.col("n_claims") > 1, "not_evaluated.duplicate_claim")
        .when(F.col("value").isNull(), "not_evaluated.category_missing")
        .otherwise(F.concat(F.lit("categorical."), "comparison", F.lit("."), F.when(hit, "match").otherwise("mismatch")))
    )
    status = F.when(F.col("rule").startswith("not_evaluated"), "not_evaluated").when(F.col("rule").endswith(".match"), "pass").otherwise("fail")
    return grouped.join(requirements, key).withColumn("rule", rule).select(key, "n_claims", "rule", status.alias("status"))


def display_upper(verdicts: DataFrame, factor_num: int, factor_den: int, quantum: int) -> DataFrame:
    """``display_upper``: the upper bound in a display unit, rounded half-even to ``quantum`` of that unit's minor parts."""
    scaled, step = F.col("upper") * factor_den, F.lit(factor_num * quantum)
    rest = F.pmod(scaled, step)
    whole = F.call_function("div", scaled - rest, step)
    up = (rest * 2 > step) | ((rest * 2 == step) & (F.pmod(whole, F.lit(2)) == 1))
    return verdicts.withColumn("display_upper", (whole + up.cast("long")) * quantum)
