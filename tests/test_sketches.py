"""Quantile sketches merged over batches against exact values; catalogues of grids; spellings of booleans."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import search


def test_sketches_merge_within_their_rank_error(spark):
    rows = spark.range(120_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 30).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003))).alias("duration_ms"))
    rows = rows.withColumn("duration_ms", F.when(F.col("g") == 0, F.col("duration_ms") * F.col("duration_ms")).otherwise(F.col("duration_ms")))
    kept = [search.sketch_durations(rows.filter(F.col("day") % 3 == k), ["g", "day"]) for k in range(3)]
    by_day = kept[0].unionByName(kept[1]).unionByName(kept[2])
    stats = {r.g: r for r in search.sketched_stats(search.merge_sketches(by_day, ["g", "day"]), ["g"]).collect()}
    for g in (0, 1):
        values = sorted(r.duration_ms for r in rows.filter(F.col("g") == g).collect())
        assert stats[g].n == len(values) and stats[g].total == sum(values)
        for q, found in ((0.5, stats[g].p50), (0.9, stats[g].p90)):
            below, upto = sum(v < found for v in values) / len(values), sum(v <= found for v in values) / len(values)
            assert below <= q + search.RANK_ERROR and upto >= q - search.RANK_ERROR


def test_sketches_of_small_groups_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("a", 5), ("a", None), ("b", 7), ("b", 9)], "g string, duration_ms long")
    found = {r.g: (r.n, r.total, r.p50, r.p90) for r in search.sketched_stats(search.sketch_durations(rows, ["g"]), ["g"]).collect()}
    assert found["a"] == (1, 5, 5.0, 5.0) and found["b"][:2] == (2, 16) and found["b"][2] in (7.0, 9.0) and found["b"][3] == 9.0
    assert search.sketched_stats(search.sketch_durations(rows.filter("false"), ["g"]), ["g"]).count() == 0


def test_grids_of_too_many_materials_are_refused(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_MATERIALS", 3)
    names = lambda n: spark.createDataFrame([(f"m{i}",) for i in range(n)], "material string")
    assert search.enumerate_grid(names(3), [1], 2).count() == 3 + 6
    with pytest.raises(ValueError):
        search.enumerate_grid(names(4), [1], 2)
