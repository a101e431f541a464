"""Fixture views over the test tables, in SQL that Spark and DuckDB both run.

They stand in for the evidence tables (units, requirements, claims, runs, transitions, graphs, trees,
calls) and use integer arithmetic after one rounding, so both engines give identical rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from assayer.operators.ordered import number_rows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "f_kinds": """SELECT * FROM (VALUES ('money','cent',1,1), ('money','usd',100,1), ('money','mill',1,10), ('mass','kg',1,1), ('mass','g',1,1000)) AS t(kind, unit, factor_num, factor_den)""",
    "f_requirements": """SELECT p_partkey AS requirement_id, 'money' AS kind, 'cent' AS unit,
 CASE p_partkey % 5 WHEN 0 THEN 'less_than' WHEN 1 THEN 'less_than_or_equal' WHEN 2 THEN 'greater_than' WHEN 3 THEN 'greater_than_or_equal' ELSE 'equal' END AS comparison,
 CASE WHEN p_partkey % 15 < 5 THEN 'bounded' WHEN p_partkey % 15 < 10 THEN 'enclosure' ELSE 'nominal' END AS basis,
 CAST(ROUND(p_retailprice * 100) AS BIGINT) * (1 + p_partkey % 4) AS limit_minor, CAST(p_size * 1000 AS BIGINT) AS tolerance_minor,
 p_partkey % 3 <> 0 AS permit_nominal, CASE p_partkey % 7 WHEN 0 THEN CAST(0.99 AS DECIMAL(9,6)) WHEN 1 THEN CAST(0.9 AS DECIMAL(9,6)) END AS required_coverage FROM part""",
    "f_claims": """SELECT claim_id, attempt_id, requirement_id, step_id, ordinal, CASE WHEN model LIKE 'worst%' THEN 'worst_case' ELSE model END AS model, state,
 CASE WHEN model = 'coverage_interval' THEN CAST(0.95 AS DECIMAL(9,6)) END AS coverage,
 CASE WHEN model IN ('interval','coverage_interval','worst_case_lower') THEN nominal_minor - CAST(ROUND(nominal_minor * l_discount) AS BIGINT) END AS lower_minor,
 CASE WHEN model IN ('interval','coverage_interval','worst_case_upper') THEN nominal_minor + CAST(ROUND(nominal_minor * l_tax) AS BIGINT) END AS upper_minor,
 CASE WHEN model IN ('exact','coverage_interval','unquantified') THEN nominal_minor END AS nominal_minor
 FROM (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS attempt_id, l_partkey AS requirement_id, l_suppkey AS step_id, l_linenumber AS ordinal,
 CASE l_linenumber WHEN 1 THEN 'exact' WHEN 2 THEN 'interval' WHEN 3 THEN 'coverage_interval' WHEN 4 THEN 'worst_case_upper' WHEN 5 THEN 'worst_case_lower' WHEN 6 THEN 'unquantified' ELSE 'interval' END AS model,
 CASE WHEN l_returnflag = 'R' THEN 'quarantined' ELSE 'admitted' END AS state,
 CAST(ROUND(l_extendedprice * 100 / l_quantity) AS BIGINT) AS nominal_minor, l_discount, l_tax FROM lineitem) t""",
    "f_runs": """SELECT line, attempt_id, case_id, CASE WHEN line > 1 THEN CAST(FLOOR(line / 2) AS BIGINT) END AS parent_line, CAST(FLOOR(LOG2(line)) AS BIGINT) AS generation, status, recorded_at
 FROM (SELECT ROW_NUMBER() OVER (ORDER BY o_orderkey) AS line, o_orderkey AS attempt_id, o_custkey AS case_id,
 CASE o_orderstatus WHEN 'F' THEN 'evaluated' WHEN 'O' THEN 'planned' ELSE 'rejected' END AS status, o_orderdate AS recorded_at FROM orders) t""",
    # What the run log holds at a line: most are runs, some are records, older rows, broken or spoiled.
    "f_log": """SELECT *, CASE WHEN line % 50 = 0 THEN 'broken' WHEN line % 41 = 0 THEN 'blank' WHEN line % 37 = 0 THEN 'unknown' WHEN line % 10 = 0 THEN 'move'
 WHEN line % 29 = 0 THEN 'older' WHEN line % 31 = 0 THEN 'older_spoiled' WHEN line % 23 = 0 THEN 'version' WHEN line % 19 = 0 THEN 'stepless' ELSE 'run' END AS kind FROM f_runs""",
    "f_transitions": """SELECT event_id AS transition_id, 'campaign' AS subject_kind, user_id AS subject, ts AS at_time,
 CASE event_type WHEN 'signup' THEN 'running' WHEN 'view' THEN 'blocked' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END AS to_state FROM events""",
    "f_edges": """SELECT p_partkey AS dst_step, CAST(FLOOR(p_partkey / 2) AS BIGINT) AS src_step, 'a' AS dst_slot FROM part WHERE p_partkey > 1
 UNION ALL SELECT p_partkey, CAST(FLOOR(p_partkey / 3) AS BIGINT), 'b' FROM part WHERE p_partkey > 2""",
    "f_state_kv": """SELECT l_orderkey AS attempt_id, '/lines/' || CAST(l_linenumber AS VARCHAR(10)) || '/quantity' AS pointer, CAST(l_quantity AS BIGINT) AS value FROM lineitem""",
    "f_tree_files": """SELECT source AS tree, CAST(doc_id AS VARCHAR(20)) AS path, SHA(text) AS sha256, CAST(LENGTH(text) AS BIGINT) AS bytes FROM documents""",
    "f_calls": """SELECT conv_id, turn, role, text, LEAD(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations""",
    "f_front": """SELECT p_partkey AS id, p_brand AS grp, p_size AS x, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS y FROM part""",
}


def _needs(sql: str) -> list[str]:
    """The views that a text names, and those that they name, in order of definition."""
    found = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    if "f_log" in found:
        found.add("f_runs")
    return [v for v in VIEWS if v in found]


def duck(sql: str) -> str:
    """SQL for DuckDB: the named views as common tables before it."""
    views = ",\n".join(f"{v} AS ({VIEWS[v].replace('SHA(text)', 'sha256(text)')})" for v in _needs(sql))
    sql = sql.strip()
    if not views:
        return sql
    if re.match(r"with\s+recursive\b", sql, re.I):
        return f"WITH RECURSIVE {views},\n" + re.sub(r"^with\s+recursive\b", "", sql, flags=re.I)
    return f"WITH {views},\n" + re.sub(r"^with\b", "", sql, flags=re.I) if re.match(r"with\b", sql, re.I) else f"WITH {views}\n{sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "f_log":
        return spark.sql(VIEWS[name].replace("f_runs", "{runs}"), runs=view(spark, sf_dir, "f_runs"))
    if name == "f_runs":  # numbered without a sort of all orders in one task
        orders = view(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        sql = VIEWS[name].replace("ROW_NUMBER() OVER (ORDER BY o_orderkey)", "place + 1").replace("FROM orders", "FROM {orders}")
        return spark.sql(sql, orders=number_rows(orders, ["o_orderkey"], name="place"))
    sql = VIEWS[name].replace("SHA(text)", "sha2(text, 256)")
    for t in TABLES:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
