"""Ledgers whose writers die at every point; histories and bundles read back."""

import os

import duckdb
import pytest

from assayer.plans import registry
from assayer.sources import ledger

from .oracle import duck_rows, spark_rows

SCHEMA = "id long, case_id string, seq long"


def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(history):
    return sorted((r.batch, r.id, r.seq, r.accepted) for r in history.rows().collect())


def history(spark, path):
    return ledger.History(spark, path, records(spark, []).schema, ["id"], "seq")


ONE = [(1, "a", 10), (2, "b", 11), (1, "a", 12), (3, None, 13), (4, "a", 14), (4, "a", 14)]
TWO = [(1, "a", 5), (5, "b", 20), (5, "b", 21)]
WANT = [("one", 1, 10, True), ("one", 1, 12, False), ("one", 2, 11, True), ("one", 3, 13, True), ("one", 4, 14, False), ("one", 4, 14, True), ("two", 1, 5, False), ("two", 5, 20, True), ("two", 5, 21, False)]


def test_ids_once_and_retries(spark, tmp_path):
    h = history(spark, f"file://{tmp_path}/h")
    assert h.rows().count() == 0
    assert h.append("one", records(spark, ONE)) and h.append("two", records(spark, TWO))
    assert not h.append("one", records(spark, ONE)) and not h.append("two", records(spark, TWO))
    assert read(h) == WANT and {k: m["rows"] for k, m in h.ledger.manifests().items()} == {"one": 6, "two": 3}
    assert h.append("none", records(spark, [])) and read(history(spark, f"file://{tmp_path}/h")) == WANT
    assert any("case_part=" in d for d in os.listdir(tmp_path / "h/data/batch=one/accepted=true"))


class Died(Exception):
    pass


@pytest.mark.parametrize("point", ["before the rows", "half of the rows", "before the manifest", "before the rename"])
def test_a_killed_writer_runs_again(spark, tmp_path, monkeypatch, point):
    path = f"file://{tmp_path}/h"
    history(spark, path).append("one", records(spark, ONE))
    h = history(spark, path)

    def die(*_, **__):
        raise Died

    with monkeypatch.context() as m:
        if point == "before the rows":
            m.setattr(ledger.integrity, "append_history", die)
        elif point == "half of the rows":
            half = records(spark, TWO[:1]).selectExpr("*", "true AS accepted", "0 AS case_part")
            half.write.partitionBy("accepted", "case_part").parquet(f"{path}/data/batch=two")
            m.setattr(ledger.integrity, "append_history", die)
        elif point == "before the manifest":
            m.setattr(ledger.Ledger, "_commit", die)
        else:
            staged = tmp_path / "h/manifest/.two.json.tmp"
            staged.write_text("{half")
            m.setattr(ledger.Ledger, "_commit", die)
        with pytest.raises(Died):
            h.append("two", records(spark, TWO))
    assert read(h) == [r for r in WANT if r[0] == "one"]  # no reader sees the dead writer's rows
    assert history(spark, path).append("two", records(spark, TWO))
    assert read(h) == WANT


def test_another_batch_comes_between_a_death_and_its_retry(spark, tmp_path, monkeypatch):
    h = history(spark, f"file://{tmp_path}/h")
    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_commit", lambda *_: (_ for _ in ()).throw(Died()))
        with pytest.raises(Died):
            h.append("one", records(spark, ONE))
    h.append("two", records(spark, TWO))
    h.append("one", records(spark, ONE))
    ids = [r.id for r in h.rows().filter("accepted").collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5] and h.rows().count() == len(ONE) + len(TWO)


def test_names_of_batches(spark, tmp_path):
    h = history(spark, f"file://{tmp_path}/h")
    for name in ("", "../x", "a/b", "a b", ".hidden"):
        with pytest.raises(ValueError):
            h.append(name, records(spark, ONE))


def test_blocked_bundles_leave_no_row(spark, tmp_path):
    fields = "bundle_id string, path string, sha256 string, bytes long"
    manifest = spark.createDataFrame([("a", "x", "1", 1), ("a", "y", "2", 2), ("b", "x", "1", 1), ("b", "y", "9", 2), ("c", "x", "3", 3), ("d", "x", "4", 4)], fields)
    observed = spark.createDataFrame([("a", "x", "1", 1), ("a", "y", "2", 2), ("b", "x", "1", 1), ("b", "y", "2", 2), ("d", "x", "4", 5), ("e", "x", "4", 4)], fields)
    out = ledger.Ledger(spark, f"file://{tmp_path}/out", manifest.selectExpr("*", "0 AS bundle_part").schema, ["bundle_part"])
    decided = ledger.export_bundles(manifest, observed, out, "first").collect()
    assert {(r.bundle_id, r.bundle_ok) for r in decided} == {("a", True), ("b", False), ("c", False), ("d", False)}
    assert sorted((r.bundle_id, r.path) for r in out.rows().collect()) == [("a", "x"), ("a", "y")]
    again = ledger.export_bundles(manifest, manifest, out, "first")
    assert again.filter("not bundle_ok").count() == 0 and out.rows().count() == 2  # a committed export stays as it is
    ledger.export_bundles(manifest, manifest, out, "second")
    assert out.rows(["second"]).count() == 6


def test_null_ids_null_places_and_ties(spark, tmp_path):
    """Every record is kept once: null is an id, a null place comes last, equal places are told apart by the other columns."""
    h = history(spark, f"file://{tmp_path}/h")
    one = [(None, "a", 3), (None, "a", 2), (1, "a", None), (1, "b", 7), (2, "a", None), (2, "a", None)] + [(3, f"c{k:03}", 5) for k in range(200)]
    assert h.append("one", records(spark, one).repartition(7)) and h.append("two", records(spark, [(None, "a", 1), (2, "a", 1), (4, None, None)]))
    rows = [(r.batch, r.id, r.case_id, r.seq) for r in h.rows().collect()]
    assert sorted(rows, key=repr) == sorted([("one", *r) for r in one] + [("two", None, "a", 1), ("two", 2, "a", 1), ("two", 4, None, None)], key=repr)
    accepted = {(r.batch, r.id, r.case_id, r.seq) for r in h.rows().filter("accepted").collect()}
    assert accepted == {("one", None, "a", 2), ("one", 1, "b", 7), ("one", 2, "a", None), ("one", 3, "c000", 5), ("two", 4, None, None)}


def test_lines_with_null_and_negative_keys_as_in_sql(spark, tmp_path):
    lines = [(1, None, 1, 1), (2, None, 2, 1), (None, 5, 3, 1), (None, 6, 3, 1), (-1, 5, 4, 2), (-1, None, 4, 3), (3, 5, 5, None), (3, 7, 5, None), (4, 7, 6, 2), (6, 7, None, None), (8, 5, 1, 1), (8, 5, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(3,), (6,)], "p_partkey long").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    for table in ("lineitem", "part"):
        duck.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    for name in ("a7_append_table", "a7_append_history"):
        assert spark_rows(registry.queries()[name](spark, str(tmp_path))) == duck_rows(duck, registry.oracle_sql()[name]), name
