"""Scans over ranges against plain loops; hot groups in many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import search, transitions
from assayer.operators.ordered import scan


@pytest.mark.parametrize("hot", [False, True])
def test_running_values(spark, hot):
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else f"g{g}", int(n), None if rng.random() < 0.3 else int(rng.integers(-50, 50))) for n in rng.permutation(400) for g in [0 if hot and rng.random() < 0.9 else int(rng.integers(0, 5))]]
    df = spark.createDataFrame(rows, "g string, n long, v long").selectExpr("*", "'x' AS other")
    got = scan(df, ["n"], ["g"], total=("sum", F.col("v")), place=("sum", F.lit(1)), high=("highest", F.col("v")), last=("last", F.col("v")), before=("previous", F.col("v"))).collect()
    assert len(got) == len(rows) and got[0].other == "x"
    found = {(r.g, r.n): (r.total, r.place, r.high, r.last, r.before) for r in got}
    for g in {r[0] for r in rows}:
        total, place, high, last, before = 0, 0, None, None, None
        for _, n, v in sorted(r for r in rows if r[0] == g) if g is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1]):
            total, place, last = total + (v or 0), place + 1, v if v is not None else last
            assert found[g, n] == (total, place, high, last, before)
            high, before = max((x for x in (high, v) if x is not None), default=None), v


def test_a_hot_group_is_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("g"), F.col("id").alias("n"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else so few rows become one range
    try:
        numbered = scan(df, ["n"], ["g"], place=("sum", F.lit(1)))
        assert numbered.filter("place <> n + 1").count() == 0
        sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 40_000
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("tolerance", [0, 3])
def test_best_so_far(spark, tolerance):
    rng = np.random.default_rng(8)
    rows = [(f"a{i % 2}", i, None if i % 11 == 0 else int(rng.integers(0, 10 + i))) for i in range(300)]
    got = {(r.arm, r.line): (r.best, r.since) for r in search.best_so_far(spark.createDataFrame(rows, "arm string, line long, worst long"), ["arm"], "worst", tolerance).collect()}
    for arm in ("a0", "a1"):
        best, since = None, 0
        for _, line, v in [r for r in rows if r[0] == arm]:
            since += 1
            if v is not None and (best is None or v > best + tolerance):
                best, since = v, 0
            assert got[arm, line] == (best, since)


def test_states_before_moves(spark):
    rows = [("campaign", 1, i, i // 2, s) for i, s in enumerate(["running", "blocked", "running", None, "completed"])] + [("step", 1, 9, 0, "reused")]
    df = spark.createDataFrame(rows, "subject_kind string, subject long, transition_id long, at_time long, to_state string")
    got = {(r.subject_kind, r.transition_id): r.derived_state for r in transitions.with_previous(df, ["at_time", "transition_id"]).collect()}
    assert got == {("campaign", 0): "planned", ("campaign", 1): "running", ("campaign", 2): "blocked", ("campaign", 3): "running", ("campaign", 4): "planned", ("step", 9): "pending"}
    assert transitions.with_previous(df.filter("false"), ["at_time", "transition_id"]).count() == 0
