"""Queries that run the streaming jobs over what the tables hold; the SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans.history_queries import spark_sql
from assayer.plans.integrity_queries import _log_lines
from assayer.plans.registry import query
from assayer.plans.verdict_queries import PER_ATTEMPT
from assayer.storage import fresh_path
from assayer.streaming import streams

# The watermark trails the last event by the delay; what lies beyond it is not final yet.
MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _stream(v, rows, batches=None):
    """Rows as a stream: written once, then read as they lie there, in at most ``batches`` that each have rows from everywhere."""
    spark = rows.sparkSession
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})  # as watermarks ask
    path = fresh_path(spark, "stream-source")
    if batches is None:
        rows.write.parquet(path)
        return spark.readStream.schema(rows.schema).parquet(path)
    dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(batches))
    for batch in range(batches):  # files are read in the order of their writing
        rows.filter(dealt == batch).write.mode("append").option("compression", "zstd").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


@query("""SELECT CASE kind WHEN 'broken' THEN 'unreadable' WHEN 'unknown' THEN 'unknown_record_kind' WHEN 'version' THEN 'schema_version_unknown' WHEN 'stepless' THEN 'steps_missing' WHEN 'older_spoiled' THEN 'campaign_digest' ELSE 'valid' END AS outcome, count(*) AS n FROM f_log WHERE kind <> 'blank' GROUP BY 1""")
def l1_stream_run_log(v):
    path = _log_lines(v)
    spark = v("orders").sparkSession
    good, bad = fresh_path(spark, "good"), fresh_path(spark, "bad")
    streams.split_run_log(spark, path, good, bad, ["run/1"])
    outcome = spark.read.parquet(good).select(F.lit("valid").alias("outcome")).unionByName(spark.read.parquet(bad).select(F.col("problem").alias("outcome")))
    return outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY subject ORDER BY at_time, transition_id), 'planned') AS from_state FROM f_transitions)
SELECT subject, transition_id, from_state, to_state, (from_state, to_state) IN (('planned','running'),('planned','cancelled'),('running','blocked'),('running','completed'),('running','cancelled'),('running','superseded'),('blocked','running'),('blocked','cancelled'),('blocked','superseded'),('completed','invalidated')) AS legal
FROM t WHERE at_time <= {MARK}""")
def l2_stream_transitions(v):
    out = streams.drain(streams.stream_transitions(_stream(v, v("f_transitions"))), "transitions")
    return out.select("subject", "transition_id", "from_state", "to_state", "legal")


GATES = "SELECT user_id AS request, CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'routed' ELSE 'opened' END AS kind, ts AS at_time, CASE WHEN event_type <> 'purchase' OR user_id % 2 = 1 THEN ts + INTERVAL '2' DAY END AS respond_by FROM events"


@query(f"""WITH g AS ({GATES}), r AS (SELECT request, min(respond_by) AS respond_by, bool_or(kind = 'routed') AS routed FROM g GROUP BY request) SELECT request, respond_by FROM r WHERE NOT routed AND respond_by < (SELECT max(at_time) - INTERVAL 1 HOUR FROM g)""")
def l3_stream_gate_lapse(v):
    out = streams.drain(streams.stream_gate_lapse(_stream(v, spark_sql(v, GATES, "events"))), "lapsed")
    return out.withColumn("respond_by", F.col("respond_by").cast("timestamp_ntz"))


@query(f"""SELECT date_trunc('day', ts) AS from_time, date_trunc('day', ts) + INTERVAL 1 DAY AS to_time, event_type AS state, count(*) AS n, arg_max(event_id, ts) AS last_id FROM events GROUP BY 1, 2, 3 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {MARK}""")
def l4_stream_supervision(v):
    rows = v("events").select(F.col("ts").alias("at_time"), F.col("event_type").alias("state"), F.col("event_id").alias("id"))
    return streams.drain(streams.stream_supervision(_stream(v, rows)), "supervision").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_time", "to_time")})


# Events come in three batches by id, each spread over all days, so that most of the later two is late for its day.
LATE = """WITH b AS (SELECT *, (event_id + 1) % 3 AS batch FROM events),
m AS (SELECT n.batch, max(ts) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT batch FROM b) n JOIN b ON b.batch < n.batch GROUP BY n.batch),
x AS (SELECT b.*, date_trunc('day', ts) AS from_time, date_trunc('day', ts) + INTERVAL 1 DAY AS to_time, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM b LEFT JOIN m ON m.batch = b.batch)"""


@query(f"""{LATE} SELECT from_time, 'late' AS what, NULL AS user_id, NULL AS state, count(*) AS n FROM x WHERE late GROUP BY from_time
UNION ALL SELECT from_time, 'count', NULL, event_type, count(*) FROM x WHERE NOT late GROUP BY from_time, event_type
UNION ALL SELECT from_time, 'latest', user_id, arg_max(event_type, (ts, event_id)), max((ts, event_id))[2] FROM x WHERE NOT late GROUP BY from_time, user_id""")
def l4_stream_late_rows(v):
    rows = v("events").select(F.col("ts").cast("timestamp").alias("at_time"), F.col("event_type").alias("state"), F.col("user_id").alias("case_id"), F.col("event_id").alias("id"))
    spark = rows.sparkSession
    path, out = fresh_path(spark, "stream-source"), fresh_path(spark, "supervision")
    for batch in range(3):  # a file each, read in the order of their writing
        rows.filter((F.col("id") + 1) % 3 == batch).coalesce(1).write.mode("append").parquet(path)
    streams.supervise(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), out)
    counts, latest, late = streams.supervision(spark, out)
    none = F.lit(None)
    found = late.select("from_time", F.lit("late").alias("what"), none.cast("long").alias("user_id"), none.cast("string").alias("state"), "n")
    found = found.unionByName(counts.select("from_time", F.lit("count").alias("what"), none.cast("long").alias("user_id"), "state", "n"))
    found = found.unionByName(latest.select("from_time", F.lit("latest").alias("what"), F.col("case_id").alias("user_id"), "state", F.col("id").alias("n")))
    return found.withColumn("from_time", F.col("from_time").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) x GROUP BY user_id")
def l5_stream_dedup_append(v):
    rows = v("events").select("user_id", "event_type", F.col("ts").alias("at_time"))
    kept = streams.drain(streams.stream_dedup_append(_stream(v, rows), ["user_id", "event_type"], "3650 days"), "deduplicated")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT attempt_id, requirement_id, status, rule, margin FROM ({PER_ATTEMPT}) x")
def l6_stream_verdicts(v):
    requirements = v("f_requirements")
    out = fresh_path(requirements.sparkSession, "stream-verdicts")
    streams.stream_verdicts(_stream(v, v("f_claims").drop("step_id"), batches=3), requirements, ["requirement_id"], ["attempt_id"], out)
    found = streams.latest_verdicts(requirements.sparkSession, out, ["requirement_id", "attempt_id"])
    return found.select("attempt_id", "requirement_id", "status", "rule", "margin")
