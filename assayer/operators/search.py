"""Search campaigns: outcomes of runs in order, best and first passing runs, fronts, sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ordered import scan
from assayer.storage import materialize


def run_outcomes(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """``arm, line, attempt_id, all_pass, metric, worst`` per run; arms are cases."""
    found = verdicts.groupBy("attempt_id").agg(F.bool_and(F.col("status") == "pass").alias("all_pass"), F.max("margin").alias("metric"), F.min("margin").alias("worst"))
    return found.join(runs.select("attempt_id", F.col("case_id").alias("arm"), "line"), "attempt_id")


def first_pass_index(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """``by, first_pass, n_runs``: the 1-based place of a group's first run of which all verdicts pass."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("line"))
    return outcomes.withColumn("place", place).groupBy(*by).agg(F.min(F.when(F.col("all_pass"), F.col("place"))).alias("first_pass"), F.count(F.lit(1)).alias("n_runs"))


def best_feasible(outcomes: DataFrame, primary: str, secondary: str, k: int = 1, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best all-pass runs: least primary, then least secondary (null last), then first line; per group if ``by``."""
    order = [F.col(primary).asc_nulls_last(), F.col(secondary).asc_nulls_last(), F.col("line")]
    passing = outcomes.filter("all_pass")
    if not by:
        return passing.orderBy(*order).limit(k)
    if k == 1:
        rest = [c for c in outcomes.columns if c not in by]
        key = F.struct(F.col(primary).isNull(), F.col(primary), F.col(secondary).isNull(), F.col(secondary), "line")
        best = passing.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("b"))
        return best.select(*by, "b.*")
    return passing.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def lightest_passing(outcomes: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """``by, lightest, attempt_id``: the least metric among all-pass runs, and its first run."""
    return outcomes.filter("all_pass").groupBy(*by).agg(F.min(metric).alias("lightest"), F.min_by("attempt_id", F.struct(metric, "line")).alias("attempt_id"))


def rank_candidates(candidates: DataFrame, observed: DataFrame, predicted: DataFrame, beta: float) -> DataFrame:
    """``candidate, score, binding``: worst margin plus ``beta`` times its spread, an observed margin before a predicted one."""
    o = observed.select("candidate", "requirement", F.col("margin").alias("seen"))
    p = predicted.select("candidate", "requirement", F.col("mean").alias("mean"), F.col("std").alias("std"))
    both = p.join(o, ["candidate", "requirement"], "full_outer")
    margin, spread = F.coalesce("seen", "mean"), F.when(F.col("seen").isNotNull(), 0.0).otherwise(F.col("std"))
    worst = both.groupBy("candidate").agg(F.min(F.struct(margin.alias("margin"), spread.alias("std"), "requirement")).alias("w"))
    return candidates.select("candidate").join(worst, "candidate").select("candidate", (F.col("w.margin") + beta * F.col("w.std")).alias("score"), F.col("w.requirement").alias("binding"))


def pareto_front(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no row beats on both minimised columns; nulls leave, ties stay.

    Each x keeps its least y, combined before the shuffle; a running minimum over distinct x then decides.
    Without ``by`` the minimum runs inside ranges of x, and each range starts from the least y of those before it.
    """
    by = by or []
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = rows.groupBy(*by, x).agg(F.min(y).alias("__y"))
    along = by
    if not by:
        steps = materialize(steps.repartitionByRange(x).withColumn("__range", F.spark_partition_id()), "front-ranges")
        along = ["__range"]
    before = F.min("__y").over(Window.partitionBy(*along).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumn("__before", before)
    if not by:
        least, starts = None, []
        for number, low in sorted(steps.groupBy("__range").agg(F.min("__y")).collect()):  # a row per range partition
            starts.append((number, least))
            least = low if least is None else min(least, low)
        kind = steps.schema["__y"].dataType.simpleString()
        starts = F.broadcast(df.sparkSession.createDataFrame(starts, f"__range int, __start {kind}"))
        steps = steps.join(starts, "__range").withColumn("__before", F.least("__before", "__start"))
    front = steps.filter(F.col("__before").isNull() | (F.col("__y") < F.col("__before")))
    return rows.join(front.select(*by, x, F.col("__y").alias(y)), [*by, x, y], "left_semi")


#: Materials of a grid at most: the grid has the square of their number in rows.
MOST_MATERIALS = 5000


def enumerate_grid(materials: DataFrame, amounts: list[int], max_total: int, min_total: int = 0, first: str | None = None) -> DataFrame:
    """``first, second, a, b, total``: one- and two-layer ordered designs within the totals; two layers differ in material.

    A sweep is a product by definition; materials are a small catalogue of at most MOST_MATERIALS, whose names come
    to the driver once.
    """
    layer = materials.select(F.col("material").alias("first"), F.explode(F.array(*map(F.lit, amounts))).alias("a"))
    if first is not None:
        layer = layer.filter(F.col("first") == first)
    one = layer.select("first", F.lit(None).cast("string").alias("second"), "a", F.lit(0).alias("b"))
    names = sorted(r.material for r in materials.select("material").distinct().limit(MOST_MATERIALS + 1).collect())
    if len(names) > MOST_MATERIALS:
        raise ValueError(f"a grid of more than {MOST_MATERIALS} materials")
    two = layer.select("first", "a", F.explode(F.array(*map(F.lit, names))).alias("second")).filter("first <> second")
    two = two.select("first", "second", "a", F.explode(F.array(*map(F.lit, amounts))).alias("b"))
    return one.unionByName(two).withColumn("total", F.col("a") + F.col("b")).filter((F.col("total") <= max_total) & (F.col("total") >= min_total))


def design_signature(items: str = "items") -> Column:
    """``item:amount`` in order, joined by bars, of an array of ``item, amount``."""
    return F.array_join(F.transform(items, lambda i: F.concat(i["item"], F.lit(":"), i["amount"].cast("string"))), "|")


def match_optimum(sweep: DataFrame, log: DataFrame) -> DataFrame:
    """``arm, n_until``: evaluations until a design with the sweep optimum's signature appears (null if never).

    ``sweep(signature, metric, all_pass)``, ``log(arm, line, signature)``.
    """
    best = sweep.filter("all_pass").orderBy(F.col("metric").asc_nulls_last(), "signature").limit(1).select(F.col("signature").alias("optimum"))
    numbered = log.withColumn("n", F.row_number().over(Window.partitionBy("arm").orderBy("line")))
    hits = numbered.join(F.broadcast(best), F.col("signature") == F.col("optimum"), "left")  # one row
    return hits.groupBy("arm").agg(F.min(F.when(F.col("optimum").isNotNull(), F.col("n"))).alias("n_until"))


def sweep_optimum(sweep: DataFrame, by: list[str]) -> DataFrame:
    """The best all-pass grid point of each group."""
    return best_feasible(sweep, "primary", "secondary", 1, by)


def recovery_check(optimum: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """``by, optimum, recovered_after``: how many runs an arm took to reach the optimum's primary metric while passing."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("line"))
    both = outcomes.withColumn("place", place).join(optimum.select(*by, F.col("primary").alias("optimum")), by)
    hit = F.col("all_pass") & (F.col("metric") <= F.col("optimum"))
    return both.groupBy(*by).agg(F.max("optimum").alias("optimum"), F.min(F.when(hit, F.col("place"))).alias("recovered_after"))


def pair_calls(events: DataFrame) -> DataFrame:
    """Requests with their response by call id: ``call_id, wall_ms, error``; unanswered calls stay with nulls.

    ``events(call_id, kind, at_ms, error)``.
    """
    asked = events.filter("kind = 'request'").groupBy("call_id").agg(F.min("at_ms").alias("asked"))
    answers = events.filter("kind = 'response'").select("call_id", "at_ms", "error")
    found = asked.join(answers, "call_id", "left").filter(F.col("at_ms").isNull() | (F.col("at_ms") >= F.col("asked")))
    first = found.groupBy("call_id", "asked").agg(F.min(F.struct("at_ms", "error")).alias("r"))
    late = asked.join(first.select("call_id", "r"), "call_id", "left")
    return late.select("call_id", (F.col("r.at_ms") - F.col("asked")).alias("wall_ms"), F.col("r.error").alias("error"))


def scan_terms(responses: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Responses that hold a term, whatever its case, with the terms found."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))
    return responses.withColumn("terms", F.array_join(found, ",")).filter(F.col("terms") != "")


def campaign_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Per arm: lines, screened and full runs, first all-pass run, passes, best metric, refusals.

    ``outcomes`` also has ``state`` (screened, refused, full) and ``n_inconclusive``.
    """
    firsts = first_pass_index(outcomes, by)
    counts = outcomes.groupBy(*by).agg(
        F.count_if(F.col("state") == "screened").alias("n_screened"), F.count_if(F.col("state") == "full").alias("n_full"), F.count_if(F.col("state") == "refused").alias("n_refused"),
        F.count_if("all_pass").alias("n_pass"), F.min(F.when(F.col("all_pass"), F.col("metric"))).alias("best"), F.sum("n_inconclusive").alias("n_inconclusive"))
    return firsts.join(counts, by)


def trial_scores(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Per trial: evaluated runs, success, evaluations up to the first pass, lightest passing, refusals and the rest."""
    done = F.col("state") == "full"
    nth = F.sum(done.cast("long")).over(Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return outcomes.withColumn("nth", nth).groupBy(*by).agg(
        F.count_if(done).alias("n_evaluated"), F.bool_or(done & F.col("all_pass")).alias("success"), F.min(F.when(done & F.col("all_pass"), F.col("nth"))).alias("evaluations_to_pass"),
        F.min(F.when(done & F.col("all_pass"), F.col("metric"))).alias("lightest"), F.count_if(F.col("state") == "refused").alias("n_refused"), F.count_if(~F.col("state").isin("full", "refused")).alias("n_other"))


def best_so_far(rows: DataFrame, by: list[str], value: str = "worst", tolerance: float = 0) -> DataFrame:
    """``by, line, best, since``: the best value held after each row and rows since it last improved.

    A row improves on the best when it exceeds it by more than the tolerance.  Only rows above all before
    them can, so the fold runs over those few, not over the arm; without a tolerance they all do.  The fold
    streams through sorted rows and holds one row of an arm.  All else along an arm is a :func:`scan` over ranges, so a
    hot arm is the work of many tasks.  ``by`` and ``line`` name a row.
    """
    seen = scan(rows.select(*by, "line", value), ["line"], by, __n=("sum", F.lit(1)), __before=("highest", F.col(value)))
    peak = F.col(value).isNotNull() & (F.col("__before").isNull() | (F.col(value) > F.col("__before")))
    gained = peak
    if tolerance:
        seen = materialize(seen, "seen")
        peaks = seen.filter(peak).dropna(subset=by)

        def improve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for rows in batches:
                better = []
                for first, v in zip(rows["__first"], rows[value]):
                    better.append(first or v > best + tolerance)
                    best = v if better[-1] else best
                yield rows[better][[*by, "__n"]]

        in_order = peaks.select(*by, "__n", value, F.col("__before").isNull().alias("__first")).repartition(*by).sortWithinPartitions(*by, "__n")
        gains = in_order.mapInPandas(improve, peaks.select(*by, "__n").schema).withColumn("__better", F.lit(True))
        seen, gained = seen.join(gains, [*by, "__n"], "left"), F.col("__better")
    marked = seen.withColumn("__gain", F.when(gained, F.struct("__n", F.col(value).alias("v"))))
    held = scan(marked.select(*by, "line", "__n", "__gain"), ["line"], by, __last=("last", F.col("__gain")))
    return held.select(*by, "line", F.col("__last.v").alias("best"), (F.col("__n") - F.coalesce(F.col("__last.__n"), F.lit(0))).alias("since"))


def patience_exhausted(rows: DataFrame, by: list[str], rounds: int, evaluations: int) -> DataFrame:
    """``by, line, stop``: by rounds without improvement before any full evaluation, by evaluations afterwards.

    ``rows(by, line, full, since)`` with ``since`` from :func:`best_so_far`.
    """
    return scan(rows.select(*by, "line", "full", "since"), ["line"], by, n_full=("sum", F.col("full").cast("int"))).select(*by, "line", F.when(F.col("n_full") == 0, F.col("since") >= rounds).otherwise(F.col("since") >= evaluations).alias("stop"))


def refused_then_recovered(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """``by, recovered, last_class``: a refused row followed later by an all-pass one, and the last row's class."""
    refused = F.min(F.when(F.col("state") == "refused", F.col("line")))
    passed = F.max(F.when((F.col("state") == "full") & F.col("all_pass"), F.col("line")))
    last = F.max_by(F.when(F.col("state") == "refused", "refused").when(F.col("all_pass"), "pass").otherwise("other"), "line")
    return outcomes.groupBy(*by).agg(F.coalesce(refused < passed, F.lit(False)).alias("recovered"), last.alias("last_class"))


def running_screens(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """``arm, line, kind, number``: a run whose steps are all reused or skipped was screened; numbered within its kind."""
    kinds = steps.groupBy("attempt_id").agg(F.bool_and(F.col("state").isin("reused", "skipped")).alias("screened"))
    rows = runs.join(kinds, "attempt_id").withColumn("kind", F.when(F.col("screened"), "screened").otherwise("full"))
    numbered = scan(rows.select("arm", "line", "kind"), ["line"], ["arm", "kind"], number=("sum", F.lit(1)))
    return numbered.withColumn("number", F.col("number").cast("int"))


def infer_direction(observations: DataFrame) -> DataFrame:
    """``requirement_id, direction``: an upper or a lower limit, by which difference the margins agree with more often."""
    upper = F.count_if(F.col("margin") == F.col("limit") - F.col("nominal"))
    lower = F.count_if(F.col("margin") == F.col("nominal") - F.col("limit"))
    votes = observations.groupBy("requirement_id").agg(upper.alias("u"), lower.alias("l"))
    return votes.select("requirement_id", F.when(F.col("u") > F.col("l"), "upper").when(F.col("l") > F.col("u"), "lower").alias("direction"))


def rule_basis(rule: Column) -> Column:
    return F.when(rule.startswith("nominal."), "nominal").when(rule.startswith("bounded.") | rule.startswith("enclosure.") | rule.startswith("equal."), "bounded")


def unit_role(unit: Column) -> Column:
    # What a unit measures.
    roles = {"mass": ("kg", "g", "t"), "length": ("m", "cm", "mm"), "dose_rate": ("Sv/h", "mSv/h", "uSv/h"), "money": ("cent", "usd", "mill")}
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, units in roles.items():
        out = out.when(unit.isin(*units), role)
    return out


def classify_requirements(verdicts: DataFrame) -> DataFrame:
    """``requirement_id, unit, ever_bounded, role`` from ``verdicts(requirement_id, line, unit, rule)``; the latest unit counts."""
    seen = verdicts.groupBy("requirement_id").agg(F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("line"))).alias("unit"), F.bool_or(F.coalesce(rule_basis(F.col("rule")) == "bounded", F.lit(False))).alias("ever_bounded"))
    return seen.withColumn("role", unit_role(F.col("unit")))


def duration_stats(receipts: DataFrame, by: list[str], exact: bool = True) -> DataFrame:
    """``by, n, total, p50, p90``: discrete percentiles of recorded durations; approximate ones for very large groups."""
    pick = (lambda p: F.percentile("duration_ms", p)) if exact else (lambda p: F.percentile_approx("duration_ms", p, 10000).cast("double"))
    return receipts.groupBy(*by).agg(F.count("duration_ms").alias("n"), F.sum("duration_ms").alias("total"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


#: Size of a quantile sketch, and the part of all rows that a quantile's rank is off by at most (with 99 % confidence).
SKETCH_K, RANK_ERROR = 400, 0.01


def sketch_durations(receipts: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, total, sketch``: a mergeable quantile sketch of recorded durations; give a day among ``by`` and keep the rows.

    A group's values are never held together: tasks sketch what they read, and sketches of a few kilobytes merge.
    """
    value = F.col("duration_ms").cast("double")
    rows = receipts.filter("duration_ms is not null").groupBy(*by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"), F.kll_sketch_agg_double(value, F.lit(SKETCH_K)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, total, sketch`` of kept sketches, of any days and batches, merged into fewer groups."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def sketched_stats(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, total, p50, p90``: what :func:`duration_stats` gives, its percentiles within RANK_ERROR of their rank."""
    merged = merge_sketches(sketches, by)
    p = [F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in (("p50", 0.5), ("p90", 0.9))]
    return merged.select(*by, "n", "total", *p)
