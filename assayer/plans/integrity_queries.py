"""Queries over trees, packages, receipts, replays and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import integrity
from assayer.plans.history_queries import spark_sql
from assayer.plans.registry import query
from assayer.plans.verdict_queries import PER_ATTEMPT, attempts
from assayer.sources import files, ledger
from assayer.storage import fresh_path


@query("SELECT sha256, count(*) AS n_refs, max(bytes) AS bytes, CAST(sum(bytes) - max(bytes) AS BIGINT) AS saved FROM f_tree_files GROUP BY sha256")
def d14_dedup_blobs(v):
    return integrity.dedup_blobs(v("f_tree_files"))


BLOBS = "SELECT DISTINCT sha256, CASE WHEN bytes % 41 = 0 THEN 'bad' ELSE sha256 END AS observed_sha256, CASE WHEN bytes % 43 = 0 THEN bytes + 1 ELSE bytes END AS bytes FROM f_tree_files WHERE bytes % 37 <> 0 UNION ALL SELECT 'extra' || CAST(n_nationkey AS VARCHAR(9)), 'x', CAST(5 AS BIGINT) FROM nation"


def _store(v):
    blobs = spark_sql(v, BLOBS, "f_tree_files", "nation")
    return integrity.store_verify(v("f_tree_files"), blobs)


@query(f"""SELECT coalesce(w.sha256, b.sha256) AS sha256, CASE WHEN w.sha256 IS NULL THEN 'extra' WHEN b.sha256 IS NULL THEN 'missing' WHEN observed_sha256 <> b.sha256 THEN 'digest_mismatch' ELSE 'length_mismatch' END AS finding
FROM (SELECT sha256, max(bytes) AS want FROM f_tree_files GROUP BY sha256) w FULL JOIN ({BLOBS}) b ON w.sha256 = b.sha256 WHERE w.sha256 IS NULL OR b.sha256 IS NULL OR observed_sha256 <> b.sha256 OR want <> b.bytes""")
def d13_store_verify(v):
    return _store(v)[0]


@query(f"""SELECT count(w.sha256) AS n_distinct, CAST(sum(logical) AS BIGINT) AS logical_bytes, CAST(sum(want) AS BIGINT) AS distinct_bytes, CAST(sum(b.bytes) AS BIGINT) AS stored_bytes
FROM (SELECT sha256, max(bytes) AS want, sum(bytes) AS logical FROM f_tree_files GROUP BY sha256) w FULL JOIN ({BLOBS}) b ON w.sha256 = b.sha256""")
def d13_store_totals(v):
    return _store(v)[1]


ARTIFACTS = """SELECT o_custkey AS package_id, o_orderkey AS artifact_id, CASE WHEN o_orderkey % 19 = 0 THEN 'missing' WHEN o_orderkey % 23 = 0 THEN 'not_checked' WHEN o_orderkey % 29 = 0 THEN 'mismatch' WHEN o_orderkey % 2 = 0 THEN 'verified_cached' ELSE 'verified' END AS state FROM orders"""


def _package(v):
    k = F.col("o_orderkey")
    manifest = v("orders").select(F.col("o_custkey").alias("package_id"), k.alias("artifact_id"), k.alias("sha256"))
    observed = v("orders").filter("o_orderkey % 19 <> 0").select(F.col("o_custkey").alias("package_id"), k.alias("artifact_id"), F.when(k % 29 == 0, -1).otherwise(k).alias("sha256"), (k % 23 != 0).alias("checked"), (k % 2 == 0).alias("cached"))
    return integrity.package_integrity(manifest, observed)


@query(ARTIFACTS)
def d12_artifact_states(v):
    return _package(v)[0]


@query(f"SELECT package_id, CASE WHEN bool_or(state IN ('missing', 'mismatch')) THEN 'failed' WHEN bool_or(state = 'not_checked') THEN 'partial' ELSE 'complete' END AS state FROM ({ARTIFACTS}) a GROUP BY package_id")
def d12_package_integrity(v):
    return _package(v)[1]


@query("""SELECT o_custkey AS bundle_id, CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AS ok, bool_and(o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0) OVER (PARTITION BY o_custkey) AS bundle_ok FROM orders""")
def a8_export_inventory(v):
    k = F.col("o_orderkey")
    rows = v("orders").select(F.col("o_custkey").alias("bundle_id"), k.cast("string").alias("path"), k.alias("sha256"), (k % 100).alias("bytes"), k)
    observed = rows.filter(k % 31 != 0).withColumn("bytes", F.when(k % 37 == 0, -1).otherwise(F.col("bytes")))
    return integrity.export_inventory(rows.drop("o_orderkey"), observed)


A7_SQL = "SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 3 <> 0 AND row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1 AS accepted FROM lineitem"


@query(A7_SQL)
def a7_append_history(v):
    new = v("lineitem").select(F.col("l_partkey").alias("id"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"))
    accepted, refused = integrity.append_history(new, v("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")), ["id"], "seq")
    # Whether a line without a part is wanted is not known.
    return accepted.withColumn("accepted", F.when(F.col("id").isNotNull(), F.lit(True))).unionByName(refused.withColumn("accepted", F.lit(False)))


# Lines come in batches by the parity of their order (four at most: it may be null or below zero), each repeating ids of the others; the first runs twice.
A7_TABLE = """WITH l AS (SELECT l_partkey AS id, l_suppkey AS case_id, l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 2 AS batch FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch, seq) = 1 AS accepted FROM l)"""


@query(f"{A7_TABLE} SELECT 'batch' || CAST(batch AS VARCHAR) AS batch, id, case_id, seq, accepted FROM f")
def a7_append_table(v):
    new = v("lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("case_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"), "l_orderkey")
    spark = new.sparkSession
    history = ledger.History(spark, fresh_path(spark, "history"), new.drop("l_orderkey").schema, ["id"], "seq")
    parity = F.col("l_orderkey") % 2
    numbers = sorted((r[0] for r in new.select(parity).distinct().collect()), key=lambda n: (n is None, n))
    for number in numbers[:1] + numbers:
        history.append("none" if number is None else f"batch{number}", new.filter(parity.eqNullSafe(F.lit(number))).drop("l_orderkey"))
    return history.rows().withColumn("batch", F.when(F.col("batch") != "none", F.col("batch")))


@query("""WITH b AS (SELECT o_custkey AS bundle_id, o_orderkey, bool_and(o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0) OVER (PARTITION BY o_custkey) AS whole FROM orders)
SELECT bundle_id, CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS sha256, o_orderkey % 100 AS bytes, 'export' AS batch FROM b WHERE whole""")
def a8_export_bundles(v):
    k = F.col("o_orderkey")
    rows = v("orders").select(F.col("o_custkey").alias("bundle_id"), k.cast("string").alias("path"), k.alias("sha256"), (k % 100).alias("bytes"))
    observed = rows.filter(F.col("sha256") % 31 != 0).withColumn("bytes", F.when(F.col("sha256") % 37 == 0, -1).otherwise(F.col("bytes")))
    spark = rows.sparkSession
    written = ledger.Ledger(spark, fresh_path(spark, "export"), rows.withColumn("bundle_part", F.lit(0)).schema, ["bundle_part"])
    ledger.export_bundles(rows, observed, written, "export")
    return written.rows().drop("bundle_part")


B9 = "SELECT source AS tree, CASE doc_id % 11 WHEN 0 THEN '/a' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'a//b' WHEN 3 THEN '' WHEN 4 THEN 'd' WHEN 5 THEN 'd/e' ELSE 'f/' || CAST(doc_id AS VARCHAR(9)) END AS path, CAST(n_chars % 50 AS VARCHAR(9)) AS sha256, n_chars AS bytes FROM documents"


@query(f"""WITH t AS ({B9}), l AS (SELECT sha256 FROM t GROUP BY sha256 HAVING count(DISTINCT bytes) > 1)
SELECT tree, path, 'empty' AS problem FROM t WHERE path = '' UNION ALL SELECT tree, path, 'absolute' FROM t WHERE path = '/a' UNION ALL SELECT tree, path, 'dot_segment' FROM t WHERE path = 'a/../b' UNION ALL SELECT tree, path, 'empty_segment' FROM t WHERE path = 'a//b'
UNION ALL SELECT tree, path, 'lengths_differ' FROM t WHERE sha256 IN (SELECT sha256 FROM l) UNION ALL SELECT tree, path, 'file_and_folder' FROM t WHERE path = 'd' AND tree IN (SELECT tree FROM t WHERE path = 'd/e')""")
def b9_check_store_paths(v):
    return integrity.check_store_paths(spark_sql(v, B9, "documents"))


@query("""WITH r AS (SELECT o_custkey AS invocation, o_orderkey AS receipt_id, bool_and(l_quantity < 46) AS whole FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderkey),
g AS (SELECT invocation, bool_or(coalesce(whole, false)) AS whole, min(receipt_id) FILTER (whole) AS receipt_id FROM r GROUP BY invocation)
SELECT c_custkey AS step_id, CASE WHEN whole IS NULL THEN 'execute' WHEN whole THEN 'reuse' ELSE 'outputs_changed' END AS decision, CASE WHEN whole THEN receipt_id END AS receipt_id FROM customer LEFT JOIN g ON invocation = c_custkey""")
def c13_reuse_lookup(v):
    receipts = v("orders").select(F.col("o_orderkey").alias("receipt_id"), F.col("o_custkey").alias("invocation"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    observed = v("lineitem").select(F.col("l_orderkey").alias("receipt_id"), (F.col("l_quantity") < 46).alias("verified"))
    return integrity.reuse_lookup(v("customer").select(F.col("c_custkey").alias("step_id"), F.col("c_custkey").alias("invocation")), receipts, observed)


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 > 0 AND doc_id % 7 > 0 THEN sha256(text) END AS sha256, CASE WHEN doc_id % 5 > 0 AND doc_id % 7 > 0 THEN 'verified_cached' ELSE 'to_hash' END AS state FROM documents""")
def c14_cached_digest_join(v):
    d = F.col("doc_id")
    docs = v("documents")
    inventory = docs.select(d.cast("string").alias("path"), F.col("n_chars").alias("bytes"), (d % 9).alias("mtime"))
    cache = docs.filter(d % 5 > 0).select(d.cast("string").alias("path"), F.col("n_chars").alias("bytes"), F.when(d % 7 == 0, -1).otherwise(d % 9).alias("mtime"), F.sha2("text", 256).alias("sha256"))
    return integrity.cached_digest_join(inventory, cache).select("path", "sha256", "state")


@query("""SELECT coalesce(e.k, a.k) AS evidence_id, CASE WHEN e.k IS NULL THEN 'unbound' WHEN e.k % 7 = 0 THEN 'withheld' WHEN a.k IS NULL THEN 'unknown' WHEN e.k % 11 = 0 THEN 'digest_mismatch' WHEN a.k % 3 = 0 THEN 'receipted' ELSE 'bound' END AS state
FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 > 0) e FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 > 0) a ON e.k = a.k""")
def j11_verify_bindings(v):
    k = F.col("o_orderkey")
    evidence = v("orders").filter(k % 5 > 0).select(k.alias("evidence_id"), k.alias("sha256"), (k % 7 == 0).alias("withheld"))
    artifacts = v("orders").filter(k % 4 > 0).select(k.alias("evidence_id"), F.when(k % 11 == 0, -1).otherwise(k).alias("sha256"), (k % 3 == 0).alias("receipted"))
    return integrity.verify_bindings(evidence, artifacts)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), s AS (SELECT l_orderkey AS step_id, CAST(l_linenumber AS VARCHAR) AS slot, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 31 = 0) x GROUP BY l_orderkey, l_linenumber),
e AS (SELECT DISTINCT l_orderkey AS step_id, CAST(l_linenumber + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS slot FROM lineitem)
SELECT k AS step_id, 'not_expected' AS problem, '' AS detail FROM o WHERE k % 17 = 0 UNION ALL SELECT k, 'case', '' FROM o WHERE k % 17 > 0 AND k % 13 = 0 UNION ALL SELECT k, 'capability', '' FROM o WHERE k % 17 > 0 AND k % 11 = 0 UNION ALL SELECT k, 'exit_status', '' FROM o WHERE k % 7 = 0 UNION ALL SELECT k, 'invocation_digest', '' FROM o WHERE k % 19 = 0
UNION ALL SELECT coalesce(s.step_id, e.step_id), CASE WHEN e.slot IS NULL THEN 'unexpected_slot' WHEN s.slot IS NULL THEN 'missing_slot' ELSE 'duplicate_slot' END, coalesce(s.slot, e.slot) FROM s FULL JOIN e ON s.step_id = e.step_id AND s.slot = e.slot WHERE e.slot IS NULL OR s.slot IS NULL OR n > 1""")
def j12_verify_receipts(v):
    k = F.col("o_orderkey")
    receipts = v("orders").select(k.alias("step_id"), F.when(k % 13 == 0, 1).otherwise(0).alias("case_id"), F.when(k % 11 == 0, 1).otherwise(0).alias("capability"), F.when(k % 7 == 0, F.when(k % 2 == 0, 1)).otherwise(0).alias("exit_status"), k.alias("invocation"), F.when(k % 19 == 0, -1).otherwise(k).alias("derived_invocation"))
    expected = v("orders").filter(k % 17 > 0).select(k.alias("step_id"), F.lit(0).alias("case_id"), F.lit(0).alias("capability"))
    lines = v("lineitem").select("l_orderkey", "l_linenumber")
    slots = lines.unionByName(lines.filter("l_orderkey % 31 = 0")).select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").cast("string").alias("slot"))
    wanted = lines.select(F.col("l_orderkey").alias("step_id"), (F.col("l_linenumber") + (F.col("l_orderkey") % 29 == 0).cast("int")).cast("string").alias("slot"))
    return integrity.verify_receipts(receipts, expected, slots, wanted)


@query(f"""SELECT attempt_id, requirement_id, CASE WHEN attempt_id % 17 = 0 THEN 'not_checked' WHEN attempt_id % 19 = 0 AND margin IS NOT NULL THEN 'mismatch' ELSE 'verified' END AS replay FROM ({PER_ATTEMPT}) x""")
def j13_replay_verdicts(v):
    derived = attempts(v)
    recorded = derived.select("attempt_id", "requirement_id", "status", "rule", F.when(F.col("attempt_id") % 19 == 0, F.col("margin") + 1).otherwise(F.col("margin")).alias("margin"))
    return integrity.replay_verdicts(recorded, derived.filter("attempt_id % 17 <> 0"), ["attempt_id", "requirement_id"])


APPS = f"SELECT attempt_id, requirement_id, rule, status AS conclusion, 'claim' AS kind, claim_id AS id, state FROM ({PER_ATTEMPT}) x JOIN f_claims USING (attempt_id, requirement_id)"


def applications(v):
    return integrity.derive_applications(v("f_claims"), attempts(v), ["attempt_id", "requirement_id"])


@query(APPS)
def j15_derive_applications(v):
    return applications(v)


@query(f"""WITH a AS ({APPS}), b AS (SELECT attempt_id, requirement_id, CASE WHEN attempt_id % 13 = 0 THEN 'changed' ELSE conclusion END AS conclusion, CASE WHEN attempt_id % 11 = 0 THEN 'x' ELSE state END AS state FROM a WHERE attempt_id % 17 <> 0)
SELECT a.attempt_id, a.requirement_id, CASE WHEN b.attempt_id IS NULL THEN 'removed' WHEN a.attempt_id % 13 = 0 THEN 'conclusion_changed' ELSE 'premises_changed' END AS change, CASE WHEN a.attempt_id % 17 <> 0 AND a.attempt_id % 13 <> 0 THEN 'claim' END AS kinds
FROM (SELECT DISTINCT attempt_id, requirement_id FROM a) a LEFT JOIN (SELECT DISTINCT attempt_id, requirement_id FROM b) b USING (attempt_id, requirement_id) WHERE b.attempt_id IS NULL OR a.attempt_id % 13 = 0 OR a.attempt_id % 11 = 0""")
def j14_derivation_diff(v):
    before = applications(v)
    after = before.filter("attempt_id % 17 <> 0").withColumns({"conclusion": F.when(F.col("attempt_id") % 13 == 0, "changed").otherwise(F.col("conclusion")), "state": F.when(F.col("attempt_id") % 11 == 0, "x").otherwise(F.col("state"))})
    return integrity.derivation_diff(before, after, ["attempt_id", "requirement_id"])


@query("SELECT o_custkey AS request_sha256, min(o_orderdate) AS respond_by FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY o_custkey")
def j17_lapsed_gates(v):
    gates = v("orders").select(F.col("o_custkey").alias("request_sha256"), F.col("o_orderdate").alias("respond_by"))
    return integrity.lapsed_gates(gates, v("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("request_sha256")), F.lit("1995-06-01").cast("timestamp"))


@query("""SELECT attempt_id AS run_id, CASE WHEN status = 'rejected' THEN 'refused' WHEN attempt_id % 7 <> case_id % 7 AND attempt_id % 5 = 0 THEN 'reframed' WHEN attempt_id % 3 = 0 THEN 'undetected' ELSE 'honest' END AS outcome FROM f_runs""")
def j19_classify_rows(v):
    runs = v("f_runs").select(F.col("attempt_id").alias("run_id"), "case_id", "status", F.when(F.col("attempt_id") % 5 == 0, F.col("attempt_id") % 7).otherwise(F.col("case_id") % 7).alias("snapshot"), (F.col("attempt_id") % 3 == 0).alias("changed"))
    return integrity.classify_rows(runs, v("customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 7).alias("snapshot")))


@query("""SELECT event_id, event_type AS code, title, title IS NOT NULL AS explained FROM events LEFT JOIN (VALUES ('error', 'The step failed'), ('view', 'Seen'), ('click', 'Chosen')) c(code, title) ON code = event_type""")
def j20_explain_findings(v):
    events = v("events").select("event_id", F.col("event_type").alias("code"))
    catalogue = events.sparkSession.createDataFrame([("error", "The step failed"), ("view", "Seen"), ("click", "Chosen")], "code string, title string")
    return integrity.explain_findings(events, catalogue).select("event_id", "code", "title", "explained")


#: Lines of a file of the written log.
FILE_LINES = 10_000


def _log_lines(v) -> str:
    """Runs as JSON lines in the shared folder, FILE_LINES to a file, with rows of other kinds, broken or blank."""
    rows = v("f_log")
    shared = ["case_id", "status", F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at")]
    version = F.when(F.col("kind") == "version", "run/99").otherwise("run/1").alias("schema_version")
    attempt = F.struct("attempt_id", "generation").alias("attempt")
    steps = F.when(F.col("kind") != "stepless", F.array(F.struct(F.lit("screen").alias("step_id"), F.lit("executed").alias("state")))).alias("steps")
    case = F.col("case_id").cast("string").alias("case_id")
    body = F.to_json(F.struct(version, case, *shared[1:], steps, attempt))
    digest = F.concat(F.lit("sha256:"), F.when(F.col("kind") == "older", F.sha2(F.col("line").cast("string"), 256)).otherwise("beef")).alias("campaign_sha256")
    place = F.when(F.col("kind") == "older", "/work").alias("workspace")
    pairs = F.array(F.array(F.lit("screen"), F.lit("executed"))).alias("steps")
    none = F.array().cast("array<string>")
    older = F.to_json(F.struct(case, *shared[1:], digest, pairs, none.alias("verdicts"), none.alias("supplied_inputs"), place))
    move = F.to_json(F.struct(F.lit("record/1").alias("schema_version"), F.lit("state_transition").alias("record_kind"), F.struct(F.col("line").alias("transition_id")).alias("record")))
    text = (
        F.when(F.col("kind") == "broken", "{broken").when(F.col("kind") == "blank", "   ").when(F.col("kind") == "unknown", '{"schema_version":"record/1","record_kind":"riddle"}')
        .when(F.col("kind") == "move", move).when(F.col("kind").startswith("older"), older).otherwise(body)
    )
    path = fresh_path(rows.sparkSession, "run-log")
    filed = rows.select(F.expr(f"(line - 1) div {FILE_LINES}").alias("block"), "line", text.alias("value")).repartition("block").sortWithinPartitions("block", "line")
    filed.drop("line").write.partitionBy("block").text(path)
    return path


def _written_log(v):
    """The log read back, with lines counted over all its files."""
    log = files.read_run_log(v("orders").sparkSession, _log_lines(v))
    return log.withColumn("line", F.col("line") + F.regexp_extract("file", r"block=(\d+)", 1).cast("long") * FILE_LINES)


@query("""SELECT line, CASE WHEN kind = 'broken' THEN 'unreadable' WHEN kind = 'move' THEN 'state_transition' WHEN kind LIKE 'older%' THEN 'untracked' WHEN kind IN ('version', 'stepless') THEN 'run' ELSE kind END AS kind FROM f_log WHERE kind <> 'blank'""")
def a1_read_run_log(v):
    return files.with_kind(_written_log(v)).select("line", "kind")


@query("""SELECT 'run' AS kind, count(*) AS n, CAST(sum(attempt_id) AS BIGINT) AS total FROM f_log WHERE kind IN ('run', 'version', 'stepless') UNION ALL SELECT 'state_transition', count(*), CAST(sum(line) AS BIGINT) FROM f_log WHERE kind = 'move'""")
def a2_split_record_kinds(v):
    kinds = files.split_record_kinds(_written_log(v))
    runs = kinds["run"].agg(F.lit("run").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("attempt_id").alias("total"))
    moves = kinds["state_transition"].agg(F.lit("state_transition").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_variant_get(record, '$.transition_id', 'long')")).alias("total"))
    return runs.unionByName(moves)


@query("""SELECT line, problem FROM f_log JOIN (VALUES ('broken', 'unreadable'), ('unknown', 'unknown_record_kind'), ('version', 'schema_version_unknown'), ('stepless', 'steps_missing'),
('older_spoiled', 'campaign_digest'), ('older_spoiled', 'workspace_missing')) AS p(spoiled, problem) ON kind = spoiled""")
def a3_validate_log_rows(v):
    return files.validate_log_rows(_written_log(v), ["run/1"])


@query("""SELECT attempt_id, claim_id AS item_id, model AS kind FROM f_claims WHERE attempt_id IN (SELECT attempt_id FROM f_runs)""")
def a4_read_run_reports(v):
    claims = v("f_claims").groupBy("attempt_id").agg(F.collect_list(F.struct(F.col("claim_id").cast("string").alias("requirement_id"), F.col("model").alias("status"))).alias("verdicts"))
    runs = v("f_runs").join(claims, "attempt_id").select(F.col("attempt_id").cast("string").alias("run_id"), F.lit("evaluated").alias("status"), "verdicts")
    path = fresh_path(runs.sparkSession, "reports")
    runs.write.json(path)
    found = files.read_run_reports(runs.sparkSession, path)["verdicts"]
    return found.select(F.col("run_id").cast("long").alias("attempt_id"), F.col("requirement_id").cast("long").alias("item_id"), F.col("status").alias("kind"))


@query("""SELECT sum(bytes) AS bytes, count(*) AS n, count(DISTINCT sha) AS n_distinct FROM (SELECT CAST(length(r_name || chr(10)) AS BIGINT) AS bytes, r_name AS sha FROM region) x""")
def a5_inventory_tree(v):
    names = v("region").select("r_name")
    path = fresh_path(names.sparkSession, "tree")
    names.withColumn("k", F.col("r_name")).repartition("k").write.partitionBy("k").text(path)
    found = files.inventory_tree(names.sparkSession, path, "t").filter("path like '%.txt'")
    return found.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("n_distinct"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS output_id, CASE l_linenumber % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'interval' WHEN 2 THEN 'unquantified' ELSE 'categorical' END AS model, CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_partkey AS VARCHAR) END AS lower, CASE WHEN l_linenumber % 4 = 1 AND l_orderkey % 3 > 0 THEN CAST(l_partkey + 5 AS VARCHAR) END AS upper,
CASE WHEN l_linenumber % 4 IN (0, 2) THEN CAST(l_suppkey AS VARCHAR) END AS nominal, CASE WHEN l_linenumber % 4 = 3 THEN l_returnflag END AS value, CASE WHEN l_linenumber % 4 = 1 AND l_orderkey % 3 = 0 THEN 'absent:upper' END AS problem FROM lineitem""")
def a6_extract_claims(v):
    k = F.col("l_linenumber") % 4
    doc = F.to_json(F.struct(F.struct(F.col("l_partkey").cast("string").alias("low"), F.when(F.col("l_orderkey") % 3 > 0, (F.col("l_partkey") + 5).cast("string")).alias("high")).alias("bounds"), F.col("l_suppkey").cast("string").alias("best"), F.col("l_returnflag").alias("flag")))
    outputs = v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("output_id"), k.cast("string").alias("descriptor_id"), doc.alias("document"))
    descriptors = outputs.sparkSession.createDataFrame(
        [("0", "exact", None, None, "/best", None, False), ("1", "interval", "/bounds/low", "/bounds/high", None, None, False), ("2", "unquantified", None, None, "/best", None, False), ("3", "categorical", None, None, None, "/flag", False)],
        "descriptor_id string, model string, lower_at string, upper_at string, nominal_at string, value_at string, optional boolean")
    return files.extract_claims(outputs, descriptors).select("output_id", "model", "lower", "upper", "nominal", "value", "problem")
