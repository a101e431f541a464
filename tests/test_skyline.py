"""The front on many columns against comparing all rows, and the size of what a task sees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.operators import skyline

RNG = np.random.default_rng(6)


def plain(x):
    return {i for i in range(len(x)) if not ((x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1)).any()}


def anti_correlated(n, d):
    x = RNG.integers(0, 1000, (n, d)).astype(float)
    x[:, -1] = 1000 * d - x[:, :-1].sum(axis=1)
    return x


CASES = {
    "uniform": RNG.random((3000, 3)), "anti": anti_correlated(2500, 3), "ties": RNG.integers(0, 6, (2000, 4)).astype(float),
    "one column": RNG.integers(0, 50, (300, 1)).astype(float), "one cell of many": np.column_stack([np.full(900, 3.0), RNG.random(900), RNG.random(900)]),
    "ends": np.array([[np.inf, -np.inf, 0], [np.inf, 0, 0], [-np.inf, 5, 5], [1e16, 0, 0], [1e16, 0.5, 0], [0.0, -0.0, 1], [-0.0, 0.0, 1]]),
    "one point": np.ones((40, 2)), "sixteen columns": RNG.integers(0, 3, (400, 16)).astype(float),
}


@pytest.mark.parametrize("name", CASES)
def test_front_is_that_of_all_pairs(spark, name):
    x = CASES[name]
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(i=range(len(x)))).repartition(3)
    assert {r.i for r in skyline.pareto_front_nd(df, names, block=64).select("i").collect()} == plain(x)


def test_nulls_leave_and_empty_tables_pass(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 0.0), (3, 2.0, 2.0), (4, 2.0, 2.0), (5, 3.0, 2.0)], "cell int, a double, b double")
    assert sorted(r.cell for r in skyline.pareto_front_nd(df, ["a", "b"]).collect()) == [3, 4]
    assert skyline.pareto_front_nd(df.filter("false"), ["a", "b"]).count() == 0


def test_no_task_sees_the_whole_front(spark):
    x = np.unique(anti_correlated(6000, 3), axis=0)
    keys, block = ["x", "y", "z"], 256
    df = spark.createDataFrame(pd.DataFrame(x, columns=keys))
    placed = skyline._placed(df, keys, len(x), block)
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = placed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64(*keys), "blocks").cast("int"))
    every = cells.select(F.col("cell").alias("a"), F.col("blocks").alias("blocks_a")).join(cells.select(F.col("cell").alias("b"), F.col("blocks").alias("blocks_b")), F.col("a") <= F.col("b"))
    sizes = skyline.meetings(placed.select("cell", "block", *keys), every).groupBy(*skyline.MEETING).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * block < len(x)


def test_cells_are_dropped_whole():
    least, greatest = np.array([[0, 0], [1, 1], [5, 0]]), np.array([[1, 1], [2, 2], [9, 1]])
    assert skyline.living_cells(least, greatest).tolist() == [True, True, True]  # the corners (1, 1) are equal
    assert skyline.living_cells(least, greatest - [[0.5, 0], [0, 0], [0, 0]]).tolist() == [True, False, True]
    a, b = skyline.reaching_pairs(least, greatest)
    assert set(zip(a.tolist(), b.tolist())) == {(0, 0), (0, 1), (0, 2), (1, 1), (1, 0), (1, 2), (2, 2)}
