"""Surrogate models of search campaigns: features, ridge regressions, spreads, predicted margins.

Regressions need only sums of products per requirement, which Spark adds up in one pass with combining
before the shuffle; the small systems of equations are then solved by elimination over arrays, a row a
model.  A pool row meets its requirement's model once: what the resampled models say of it is a quadratic
form of its features, so predictions are neither multiplied by the resamples nor shuffled again.

Defined cases: rows with a null or NaN in a feature or in y are not learned from; a pool row with one has
null predictions; a requirement without a model has no predictions; a system without a single solution
gives no model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A feature that varies less than this is not scaled.
LEAST_SCALE = 1e-9


def feature_table(candidates: DataFrame, verdicts: DataFrame, requirements: list[str]) -> DataFrame:
    """Candidates with a column ``y_<requirement>`` each: the log of the nominal value where it is positive."""
    log = F.when(F.col("nominal") > 0, F.ln("nominal"))
    wide = verdicts.groupBy("candidate").pivot("requirement", requirements).agg(F.first(log))
    return candidates.join(wide.select("candidate", *[F.col(f"`{r}`").alias(f"y_{r}") for r in requirements]), "candidate", "left")


def _number(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _sums(rows: DataFrame, features: list[str], y: str, by: list[str], weight: Column) -> DataFrame:
    """``by, n, s_i_j``: weighted sums of products of (1, features, y) over rows that have them all."""
    x = [F.lit(1.0), *map(_number, [*features, y])]
    for value in x[1:]:
        rows = rows.filter(value.isNotNull())
    sums = [F.sum(weight * x[i] * x[j]).alias(f"s_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _eliminated(system: Column, k: int) -> Column:
    """The solution of ``k`` equations, given as rows with their right sides last; nulls without a single solution."""

    def step(m: Column, j: Column) -> Column:
        pivot = F.transform(F.get(m, j), lambda v: F.try_divide(v, F.get(F.get(m, j), j)))
        return F.transform(m, lambda row, i: F.when(i == j, pivot).otherwise(F.zip_with(row, pivot, lambda a, p: a - F.get(row, j) * p)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), system, step), lambda row: F.get(row, F.lit(k)))


def _solved(sums: DataFrame, by: list[str], k: int, alpha: float, least: int) -> DataFrame:
    s = lambda i, j: F.col(f"s_{i}_{j}") / F.col("s_0_0")
    at = range(1, k + 1)
    spread = [F.sqrt(F.greatest(s(i, i) - s(0, i) * s(0, i), F.lit(0.0))) for i in at]
    models = sums.filter((F.col("n") >= least) & (F.col("s_0_0") > 0)).withColumns({
        "intercept": s(0, k + 1), "mean": F.array(*[s(0, i) for i in at]),
        "scale": F.array(*[F.when(d > LEAST_SCALE, d).otherwise(1.0) for d in spread]),
    })

    def covariance(i: int, j: int) -> Column:
        between = s(min(i, j), max(i, j)) - F.get("mean", F.lit(i - 1)) * (F.col("intercept") if j > k else F.get("mean", F.lit(j - 1)))
        scale = F.get("scale", F.lit(i - 1)) * (F.lit(1.0) if j > k else F.get("scale", F.lit(j - 1)))
        return between / scale * F.col("s_0_0") + F.lit(alpha if i == j else 0.0)

    system = F.array(*[F.array(*[covariance(i, j) for j in range(1, k + 2)]) for i in at])
    models = models.withColumn("system", system).withColumn("coef", _eliminated(F.col("system"), k))
    return models.filter(F.forall("coef", lambda c: c.isNotNull())).select(*by, "n", "intercept", "coef", "mean", "scale")


def ridge_by_requirement(rows: DataFrame, features: list[str], y: str, by: list[str], alpha: float = 1.0, least: int = 5) -> DataFrame:
    """``by, n, intercept, coef, mean, scale``: standardised ridge regressions; no model under ``least`` samples."""
    return _solved(_sums(rows, features, y, by, F.lit(1.0)), by, len(features), alpha, least)


def hashed_draw(key: Column) -> Column:
    """A number between 0 and 1 from a hash, the same at every run."""
    return (F.pmod(F.xxhash64(key), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def poisson_thresholds() -> list[float]:
    """A draw is a Poisson(1) count of as many as it exceeds (counts beyond 8 have a chance of one in a million)."""
    return [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson_count(draw: Column) -> Column:
    return sum(((draw > t).cast("double") for t in poisson_thresholds()[1:]), (draw > poisson_thresholds()[0]).cast("double"))


def bootstrap_models(rows: DataFrame, key: str, features: list[str], y: str, by: list[str], n: int = 16, seed: int = 1, alpha: float = 1.0, least: int = 5, draw: Column | None = None) -> DataFrame:
    """Ridge models of ``n`` resamples (column ``resample``), each row weighted by a Poisson count.

    The count comes from ``draw``, a column of (row, ``resample``) between 0 and 1; by default a hash of ``key``.
    """
    drawn = rows.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if draw is None:
        draw = hashed_draw(F.concat_ws("/", F.lit(str(seed)), "resample", F.col(key).cast("string")))
    group = [*by, "resample"]
    return _solved(_sums(drawn, features, y, group, poisson_count(draw)), group, len(features), alpha, least)


def _linear(k: int, centre: str) -> tuple[Column, list[Column]]:
    """A model as its value at ``centre`` and a slope per raw feature."""
    slopes = [F.get("coef", F.lit(i)) / F.get("scale", F.lit(i)) for i in range(k)]
    value = F.col("intercept")
    for i, slope in enumerate(slopes):
        value = value + slope * (F.get(centre, F.lit(i)) - F.get("mean", F.lit(i)))
    return value, slopes


def ensemble(models: DataFrame, resampled: DataFrame, k: int, by: list[str]) -> DataFrame:
    """A row per model: ``centre``, ``value`` there, ``slopes``, and ``spread``, how resamples vary.

    ``spread`` holds the covariances of (value at the centre, slopes) over the resamples, row by row of the upper half.
    Without resamples it is zero.
    """
    value, slopes = _linear(k, "mean")
    own = models.select(*by, F.col("mean").alias("centre"), value.alias("value"), F.array(*slopes).alias("slopes"))
    value, slopes = _linear(k, "centre")
    placed = resampled.join(own.select(*by, "centre"), by)
    placed = placed.select(*by, *[c.alias(f"p_{i}") for i, c in enumerate([value, *slopes])])
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    varied = placed.groupBy(*by).agg(F.array(*[F.covar_pop(f"p_{i}", f"p_{j}") for i, j in pairs]).alias("spread"))
    none = F.array(*[F.lit(0.0)] * len(pairs))
    return own.join(varied, by, "left").withColumn("spread", F.coalesce("spread", none))


def bootstrap_spread(pool: DataFrame, models: DataFrame, resampled: DataFrame, features: list[str]) -> DataFrame:
    """Each pool row's ``candidate, requirement, mean_log, std``: the model's prediction, the spread of the resampled ones.

    ``pool(candidate, requirement, features)``; the spread is the root of a quadratic form, which is what the standard
    deviation of linear predictions is.
    """
    k = len(features)
    rows = pool.join(ensemble(models, resampled, k, ["requirement"]), "requirement")
    rows = rows.withColumns({f"__x_{i}": _number(f) - F.get("centre", F.lit(i)) for i, f in enumerate(features)})
    z = [F.lit(1.0), *[F.col(f"__x_{i}") for i in range(k)]]
    mean, variance, at = F.col("value"), F.lit(0.0), 0
    for i in range(k):
        mean = mean + F.get("slopes", F.lit(i)) * z[i + 1]
    for i in range(k + 1):
        for j in range(i, k + 1):
            variance = variance + F.lit(1.0 if i == j else 2.0) * F.get("spread", F.lit(at)) * z[i] * z[j]
            at += 1
    std = F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))))
    return rows.select("candidate", "requirement", mean.alias("mean_log"), std.alias("std"))


def predict_margins(predictions: DataFrame, specs: DataFrame) -> DataFrame:
    """``candidate, requirement, margin, std``: distance of the predicted nominal to the limit; ``specs(requirement, limit, direction)``."""
    both = predictions.join(specs, "requirement")
    nominal = F.exp("mean_log")
    margin = F.when(F.col("direction") == "upper", F.col("limit") - nominal).otherwise(nominal - F.col("limit"))
    return both.select("candidate", "requirement", margin.alias("margin"), F.abs(nominal * F.col("std")).alias("std"))


def score_pool(margins: DataFrame, beta: float) -> DataFrame:
    """``candidate, score, binding``: each candidate's worst margin plus ``beta`` times its spread; null margins are passed over."""
    known = margins.filter(F.col("margin").isNotNull())
    worst = known.groupBy("candidate").agg(F.min(F.struct("margin", "std", "requirement")).alias("w"))
    return worst.select("candidate", (F.col("w.margin") + beta * F.col("w.std")).alias("score"), F.col("w.requirement").alias("binding"))


def sensitivity(models: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """``by, feature, slope``: coefficients per unit of the raw feature."""
    rows = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.zip_with("coef", "scale", lambda c, s: c / s).alias("slope"))
    return models.select(*by, F.inline(rows))
