"""Surrogate models against NumPy, one model and one resample at a time."""

import numpy as np
import pytest

from assayer.operators import surrogate

FEATURES = ["a", "b", "c", "d"]


def fitted(x, y, w, alpha):
    mean, scale = np.average(x, axis=0, weights=w), np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z, middle = (x - mean) / scale, np.average(y, weights=w)
    coef = np.linalg.solve(z.T @ (w[:, None] * z) + alpha * np.eye(x.shape[1]), z.T @ (w * (y - middle)))
    return lambda rows: (rows - mean) / scale @ coef + middle


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 4)) * [1, 50, 0.01, 0] + [2, 1000, 0, 7]  # the last one never varies
    y = 1 + x @ [0.5, -0.02, 3, 0] + rng.normal(size=80) * 0.1
    rows = [("r", i, *map(float, p), float(q)) for i, (p, q) in enumerate(zip(x, y))]
    rows += [("few", i, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(4)]
    rows += [("r", 900, None, 1.0, 1.0, 1.0, 1.0), ("r", 901, float("nan"), 1.0, 1.0, 1.0, 1.0), ("r", 902, 1.0, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "requirement string, k int, a double, b double, c double, d double, y double"), x, y


def test_spread_is_that_of_the_resampled_predictions(spark, data):
    df, x, y = data
    by = ["requirement"]
    models = surrogate.ridge_by_requirement(df, FEATURES, "y", by, 1.5)
    assert [(m.requirement, m.n) for m in models.collect()] == [("r", 80)]
    resampled = surrogate.bootstrap_models(df, "k", FEATURES, "y", by, 6, alpha=1.5)
    pool = df.withColumnRenamed("k", "candidate")
    got = {r.candidate: r for r in surrogate.bootstrap_spread(pool, models, resampled, FEATURES).filter("requirement = 'r'").collect()}

    draws = spark.range(80).selectExpr("id", "explode(sequence(1, 6)) AS r").selectExpr("id", "r", "(pmod(xxhash64(concat_ws('/', '1', r, id)), 1073741824L) + 0.5D) / 1073741824D AS u").collect()
    weights = np.zeros((6, 80))
    for d in draws:
        weights[d.r - 1, d.id] = sum(d.u > t for t in surrogate.poisson_thresholds())
    mean, every = fitted(x, y, np.ones(80), 1.5)(x), np.stack([fitted(x, y, w, 1.5)(x) for w in weights])
    assert np.allclose([got[i].mean_log for i in range(80)], mean) and np.allclose([got[i].std for i in range(80)], every.std(axis=0))
    assert got[900].mean_log is None and got[901].std is None and got[902].mean_log is not None


def test_without_resamples_the_spread_is_zero(data):
    df, *_ = data
    models = surrogate.ridge_by_requirement(df, FEATURES, "y", ["requirement"])
    none = surrogate.bootstrap_models(df.filter("false"), "k", FEATURES, "y", ["requirement"])
    pool = df.withColumnRenamed("k", "candidate").filter("candidate < 80")
    assert {r.std for r in surrogate.bootstrap_spread(pool, models, none, FEATURES).collect()} == {0.0}


def test_a_system_without_one_solution_gives_no_model(spark):
    df = spark.createDataFrame([("r", float(i), float(i), float(i)) for i in range(9)], "requirement string, a double, b double, y double")
    assert surrogate.ridge_by_requirement(df, ["a", "b"], "y", ["requirement"], alpha=0.0).count() == 0
    assert surrogate.ridge_by_requirement(df, ["a", "b"], "y", ["requirement"], alpha=0.1).count() == 1


def test_the_worst_margin_binds(spark):
    margins = spark.createDataFrame([(1, "x", 2.0, 1.0), (1, "y", -3.0, 4.0), (1, "z", None, None), (2, "z", None, None)], "candidate int, requirement string, margin double, std double")
    assert [tuple(r) for r in surrogate.score_pool(margins, 0.5).collect()] == [(1, -1.0, "y")]


def test_models_stay_in_the_jvm(data, capsys):
    df, *_ = data
    models = surrogate.ridge_by_requirement(df, FEATURES, "y", ["requirement"])
    surrogate.bootstrap_spread(df.withColumnRenamed("k", "candidate"), models, surrogate.bootstrap_models(df, "k", FEATURES, "y", ["requirement"]), FEATURES).explain()
    assert "Python" not in capsys.readouterr().out
