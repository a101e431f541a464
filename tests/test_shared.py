"""Shared helpers, log row profiles, and stream state, each against plain Python."""

import json
import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import storage
from assayer.functions import numbers, sql
from assayer.operators import search, skyline, verdicts
from assayer.operators.ordered import number_rows
from assayer.operators.skew import join_counted
from assayer.sources import files
from assayer.streaming import streams


def test_rows_are_numbered_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(x), i) for i, (g, x) in enumerate(rng.integers(0, 6, (500, 2)))]
    df = spark.createDataFrame(rows, "g int, x int, i int").repartition(7)
    assert [r.rank for r in sorted(number_rows(df, ["x", "i"]).collect(), key=lambda r: (r.x, r.i))] == list(range(500))
    got = {(r.g, r.x, r.i): r.rank for r in number_rows(df, [F.desc("x"), F.col("i")], by=["g"]).collect()}
    for g in range(6):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r] for r in order] == list(range(len(order)))
    assert number_rows(df.filter("false"), ["x"]).count() == 0


def test_hot_keys_join_like_others(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 300}", i) for i in range(600)] + [("lost", 1)]
    df = spark.createDataFrame(rows, "k string, i int")
    counted = df.groupBy("k").count().filter("k <> 'lost'")
    got = sorted((r.k, r.i, r["count"]) for r in join_counted(df, counted, "k", "count", len(rows)).collect())
    assert got == sorted((k, i, 900 if k == "hot" else 2) for k, i in rows if k != "lost")


def test_a_shared_folder_must_be_named_off_local_mode(monkeypatch):
    conf = SimpleNamespace(get=lambda name, default: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", applicationId="x")
    with pytest.raises(ValueError):
        storage.shared_dir(SimpleNamespace(sparkContext=context))


def test_scratch_deletes_what_was_made_inside(spark):
    outside = storage.materialize(spark.range(3), "kept")
    with storage.scratch(spark):
        inside = storage.materialize(spark.range(5), "dropped")
        paths = {f.rsplit("/", 1)[0].removeprefix("file://") for f in inside.inputFiles()}
        assert paths and all(map(os.path.exists, paths))
    assert not any(map(os.path.exists, paths)) and outside.count() == 3


DIGEST = "sha256:" + "c" * 64
OLDER = {"case_id": "case", "recorded_at": "2026-09-02T00:01:00Z", "status": "evaluated", "campaign_sha256": DIGEST, "steps": [["screen", "executed"]], "verdicts": [], "supplied_inputs": [], "workspace": "/w"}
RUN = {"schema_version": "run/1", "case_id": "case", "status": "planned", "steps": [], "attempt": {"attempt_id": 1}}
PROFILES = [
    (RUN, set()), (OLDER, set()), ({**OLDER, "steps": []}, set()),
    ({**OLDER, "campaign_sha256": "sha256:deadbeef"}, {"campaign_digest"}),
    ({**OLDER, "attempt": {"attempt_id": "fake"}}, {"attempt_before_versions"}),
    ({**OLDER, "steps": [["screen"]]}, {"steps_malformed"}), ({**OLDER, "steps": [["screen", 1]]}, {"steps_malformed"}),
    ({k: OLDER[k] for k in ("case_id", "recorded_at", "campaign_sha256")} | {"status": "error"}, set()),
    ({**OLDER, "verdicts": {}, "workspace": 3}, {"verdicts_missing", "workspace_missing"}),
    ({**RUN, "schema_version": "run/99"}, {"schema_version_unknown"}), ({**RUN, "status": "odd"}, {"status_unknown"}),
    ({**RUN, "status": "error", "steps": None, "case_id": None}, set()), ({**RUN, "steps": {}}, {"steps_missing"}), ({**RUN, "case_id": 4}, {"case_id_missing"}),
    ({"schema_version": "record/1", "record_kind": "assessment", "record": {}}, set()),
    ({"schema_version": "record/1", "record_kind": "assessment", "record": []}, {"record_malformed"}),
    ({"schema_version": "record/1", "record_kind": "riddle", "record": {}}, {"unknown_record_kind"}),
]


def test_log_rows_by_profile(spark):
    rows = [(i, json.dumps(row)) for i, (row, _) in enumerate(PROFILES)] + [(99, "{broken")]
    log = spark.createDataFrame(rows, "line long, raw string").withColumn("body", F.try_parse_json("raw"))
    got = {}
    for r in files.validate_log_rows(log, ["run/1"]).collect():
        got.setdefault(r.line, set()).add(r.problem)
    assert got == {i: want for i, (_, want) in enumerate(PROFILES) if want} | {99: {"unreadable"}}
    with pytest.raises(ValueError):
        files.validate_log_rows(log, ["run/1"], strict=True)


def test_groups_split_over_stream_batches_get_one_verdict(spark, tmp_path):
    reqs = spark.createDataFrame([(1, "less_than", "bounded", None, 10, None, True)], "requirement_id long, comparison string, basis string, required_coverage double, limit_minor long, tolerance_minor long, permit_nominal boolean")
    fields = "requirement_id long, claim_id long, attempt_id long, ordinal int, model string, state string, lower_minor long, upper_minor long, nominal_minor long, coverage double, instance_id string"
    claims = [(1, i, i % 3, 1, "exact", "admitted", None, None, 4 * i, None, str(i // (2 if i % 3 == 2 else 1))) for i in range(9)]
    source, out = str(tmp_path / "claims"), str(tmp_path / "out")
    for part in (claims[:3], claims[3:6], claims[6:]):  # each group has a claim in each batch
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_verdicts(stream, reqs, ["requirement_id"], ["attempt_id"], out, F.lit("max"))
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 3
    pick = lambda df: sorted((r.attempt_id, r.n_claims, r.status, r.rule, r.margin) for r in df.collect())
    whole = verdicts.evaluate_verdicts(reqs, spark.createDataFrame(claims, fields), ["requirement_id"], ["attempt_id"], F.lit("max"))
    assert pick(streams.latest_verdicts(spark, out, ["requirement_id", "attempt_id"])) == pick(whole)


def test_staged_numbers_are_those_of_the_expression(spark):
    texts = ["0", "-0", "1e3", "12.50", "0.001", "-1.20e-4", "00", "1.", "+1", "", None, "1e9999", "123456789012345678901234567890.5", "5E+2", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = numbers.normalize_numbers(df, "t").withColumns({"c": numbers.lower_decimal(F.col("t")), "p": numbers.number_problem(F.col("t")), "i": numbers.is_canonical(F.col("t"))}).collect()
    assert all((r.canonical, r.number_problem, r.is_canonical) == (r.c, r.p, r.i) for r in rows)


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("""SELECT is_authored_decimal('1.5e3') AS a, is_authored_decimal('x') AS b, is_authored_decimal(NULL) AS c, content_identity('{}') AS d,
      timestamp_lapsed(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-02') AS e, not_after_passed(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-01') AS f""").first()
    import hashlib

    assert (row.a, row.b, row.c, row.e, row.f) == (True, False, False, True, True)
    assert row.d == "sha256:" + hashlib.sha256(b"{}").hexdigest()


@pytest.mark.parametrize("block", [3, 512])
def test_fronts_match_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(skyline, "AT_ONCE", block)
    rng = np.random.default_rng(block)
    points = rng.integers(0, 12, (150, 3))
    kept = skyline.front(np.unique(points, axis=0).astype(float))
    distinct = np.unique(points, axis=0)
    want = [not any((q <= p).all() and (q < p).any() for q in distinct) for p in distinct]
    assert kept.tolist() == want
    df = spark.createDataFrame([(i, int(p[0]), int(p[1])) for i, p in enumerate(points)], "i int, x int, y int").repartition(5)
    got = {r.i for r in search.pareto_front(df, "x", "y").collect()}
    flat = points[:, :2]
    assert got == {i for i, p in enumerate(flat) if not any((q <= p).all() and (q < p).any() for q in flat)}
