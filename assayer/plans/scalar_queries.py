"""Queries over exact numbers, intervals, logic and JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import documents, numbers
from assayer.plans.history_queries import spark_sql
from assayer.plans.registry import query

AUTHORED = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber WHEN 1 THEN CAST(l_partkey AS VARCHAR(20)) || 'e' || CAST(l_orderkey % 5 AS VARCHAR(5)) WHEN 2 THEN '-0' || CAST(l_partkey AS VARCHAR(20)) || '.' || CAST(l_suppkey AS VARCHAR(20)) || '00'
 WHEN 3 THEN CAST(l_partkey AS VARCHAR(20)) || 'E-3' WHEN 4 THEN '+' || CAST(l_partkey AS VARCHAR(20)) WHEN 5 THEN '.' || CAST(l_partkey AS VARCHAR(20)) WHEN 6 THEN '' ELSE CAST(l_partkey AS VARCHAR(20)) || '.' END AS t, l_linenumber, l_orderkey, l_partkey, l_suppkey FROM lineitem"""


@query(f"""SELECT id, t, canonical, CASE WHEN canonical IS NULL THEN false ELSE canonical = t END AS is_canonical, CASE l_linenumber WHEN 4 THEN 'leading_plus' WHEN 6 THEN 'empty' WHEN 5 THEN 'syntax' WHEN 7 THEN 'syntax' END AS number_problem
FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN CAST(l_partkey * CAST(power(10, l_orderkey % 5) AS BIGINT) AS VARCHAR)
WHEN l_linenumber = 2 THEN CASE WHEN l_partkey = 0 AND l_suppkey = 0 THEN '0' ELSE '-' || CAST(l_partkey AS VARCHAR) || CASE WHEN l_suppkey = 0 THEN '' ELSE '.' || rtrim(CAST(l_suppkey AS VARCHAR), '0') END END
WHEN l_linenumber = 3 THEN rtrim(rtrim(CAST(CAST(l_partkey AS DECIMAL(20, 3)) / 1000 AS DECIMAL(20, 3))::VARCHAR, '0'), '.') END AS canonical FROM ({AUTHORED}) a) b""")
def h1_normalize_numbers(v):
    return numbers.normalize_numbers(spark_sql(v, AUTHORED, "lineitem"), "t").select("id", "t", "canonical", "is_canonical", "number_problem")


def _pairs(v):
    return v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), numbers.rational(F.col("l_partkey") - 900, F.col("l_suppkey") + 1).alias("a"), numbers.rational(F.col("l_orderkey") % 50, F.col("l_linenumber") + 1).alias("b"))


RATIO = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey - 900 AS an, l_suppkey + 1 AS ad, l_orderkey % 50 AS bn, CAST(l_linenumber + 1 AS BIGINT) AS bd FROM lineitem"


def _low(num: str, den: str, name: str) -> str:
    return f"CAST(({num}) // gcd(({num}), ({den})) AS VARCHAR) || '/' || CAST(({den}) // gcd(({num}), ({den})) AS VARCHAR) AS {name}"


@query(f"""SELECT id, {_low('CASE WHEN ad = bd THEN an + bn ELSE an * bd + bn * ad END', 'CASE WHEN ad = bd THEN ad ELSE ad * bd END', 'added')}, {_low('CASE WHEN ad = bd THEN an - bn ELSE an * bd - bn * ad END', 'CASE WHEN ad = bd THEN ad ELSE ad * bd END', 'subtracted')},
{_low('an * bn', 'ad * bd', 'multiplied')}, CASE WHEN bn <> 0 THEN CAST((an * bd) // gcd(an * bd, ad * bn) AS VARCHAR) || '/' || CAST((ad * bn) // gcd(an * bd, ad * bn) AS VARCHAR) END AS divided, CAST(sign(an * bd - bn * ad) AS INTEGER) AS compared FROM ({RATIO}) r""")
def h3_rational_arithmetic(v):
    rows = _pairs(v)
    a, b = F.col("a"), F.col("b")

    def text(c):
        return F.concat(F.col(f"{c}.num").cast("string"), F.lit("/"), F.col(f"{c}.den").cast("string")).alias(c)

    found = {"added": numbers.exact_add(a, b), "subtracted": numbers.exact_sub(a, b), "multiplied": numbers.exact_mul(a, b), "divided": numbers.exact_div(a, b)}
    rows = rows.withColumns({k: numbers.reduced(c) for k, c in found.items()} | {"compared": numbers.exact_cmp(a, b)})
    return rows.select("id", *map(text, found), "compared")


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CASE WHEN m % 100 > 50 OR (m % 100 = 50 AND (m // 100) % 2 = 1) THEN m // 100 + 1 ELSE m // 100 END AS VARCHAR) AS shown, m // 100 * 100 + m % 100 AS minor
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS m FROM lineitem) x""")
def h5_display_quantities(v):
    m = F.round(F.col("l_extendedprice") * 100).cast("long")
    return v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), numbers.fixed_decimal((m.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)"), 0).alias("shown"), m.alias("minor"))


@query(f"""SELECT claim_id, CAST(nominal_minor // gcd(nominal_minor, 100) AS VARCHAR) || '/' || CAST(100 // gcd(nominal_minor, 100) AS VARCHAR) AS in_usd, CAST(nominal_minor * 10 AS VARCHAR) || '/1' AS in_mill FROM f_claims WHERE nominal_minor > 0""")
def h7_value_in_unit(v):
    rows = v("f_claims").filter("nominal_minor > 0")
    one = F.lit(1)

    def text(n, d):
        r = numbers.reduced(numbers.value_in_unit(F.col("nominal_minor"), one, F.lit(n), F.lit(d)))
        return F.concat(r["num"].cast("string"), F.lit("/"), r["den"].cast("string"))

    return rows.select("claim_id", text(100, 1).alias("in_usd"), text(1, 10).alias("in_mill"))


@query("""SELECT id, CASE WHEN ka = kb THEN al + bl END AS sum_lower, CASE WHEN ka = kb THEN au + bu END AS sum_upper, CASE WHEN ka = kb THEN al - bu END AS difference_lower, CASE WHEN ka = kb THEN au - bl END AS difference_upper,
CASE WHEN ka = 0 AND kb = 1 THEN least(al * bl, al * bu, au * bl, au * bu) END AS product_lower, CASE WHEN ka = 0 AND kb = 1 THEN greatest(al * bl, al * bu, au * bl, au * bu) END AS product_upper
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey - 1000 AS al, l_partkey - 1000 + l_linenumber * 100 AS au, l_suppkey - 50 AS bl, l_suppkey - 50 + l_linenumber * 10 AS bu, l_orderkey % 2 AS ka, l_partkey % 2 AS kb FROM lineitem) x""")
def h8_combine_intervals(v):
    kind = lambda c: F.when(c % 2 == 0, "length").otherwise("force")
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    rows = v("lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), numbers.interval(p - 1000, p - 1000 + n * 100, kind(F.col("l_orderkey"))).alias("a"), numbers.interval(s - 50, s - 50 + n * 10, kind(p)).alias("b"))
    products = rows.sparkSession.createDataFrame([("length", "force", "work")], "kind_a string, kind_b string, kind string")
    out = numbers.combine_intervals(rows, products)
    return out.select("id", *[F.col(f"{c}.{e}").alias(f"{c}_{e}") for c in ("sum", "difference", "product") for e in ("lower", "upper")])


DOCS = """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '[1.5]' WHEN event_id % 19 = 0 THEN '[9007199254740993]' WHEN event_id % 23 = 0 THEN '[1,' WHEN event_id % 29 = 0 THEN replace('<"k":1,"k":2', '<', chr(123)) || chr(125) ELSE chr(123) || '"z": [' || CAST(event_id % 7 AS VARCHAR(9)) || ', "1.5"], "a": ' || props || ' , "k": null' || chr(125) END AS doc FROM events"""


@query(f"""SELECT event_id, json_problem, canonical, CASE WHEN canonical IS NOT NULL THEN 'sha256:' || sha256(canonical) END AS identity FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'not_an_integer' WHEN event_id % 19 = 0 THEN 'integer_range' WHEN event_id % 23 = 0 OR event_id % 29 = 0 THEN 'not_json' END AS json_problem,
CASE WHEN event_id % 17 > 0 AND event_id % 19 > 0 AND event_id % 23 > 0 AND event_id % 29 > 0 THEN '{{"a":' || replace(props, ' ', '') || ',"k":null,"z":[' || CAST(event_id % 7 AS VARCHAR) || ',"1.5"]}}' END AS canonical FROM events) x""")
def h10_canonicalize_documents(v):
    return documents.canonicalize_documents(spark_sql(v, DOCS, "events"), "doc").select("event_id", "json_problem", "canonical", "identity")


@query("""SELECT event_id, '' AS pointer, 'object' AS type, NULL AS value, 2 AS size FROM events UNION ALL SELECT event_id, '/a~1b', 'array', NULL, 2 FROM events UNION ALL SELECT event_id, '/a~1b/0', 'integer', CAST(event_id % 9 AS VARCHAR), NULL FROM events UNION ALL SELECT event_id, '/a~1b/1', 'string', event_type, NULL FROM events
UNION ALL SELECT event_id, '/p', 'object', NULL, 1 FROM events UNION ALL SELECT event_id, '/p/k', 'integer', json_extract_string(props, '$.k'), NULL FROM events""")
def h12_flatten_documents(v):
    doc = F.concat(F.lit('{"a/b":['), (F.col("event_id") % 9).cast("string"), F.lit(',"'), "event_type", F.lit('"],"p":'), "props", F.lit("}"))
    return documents.flatten_documents(v("events").select("event_id", doc.alias("doc")), "event_id", "doc")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber), o AS (SELECT DISTINCT l_orderkey FROM x),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 0 ELSE q END AS q FROM x WHERE l_linenumber <> 2 OR l_orderkey % 3 > 0 UNION ALL SELECT l_orderkey, 9, 1 FROM o WHERE l_orderkey % 5 = 0)
SELECT coalesce(x.l_orderkey, b.l_orderkey) AS l_orderkey, '/lines/' || CAST(coalesce(x.l_linenumber, b.l_linenumber) AS VARCHAR) AS pointer, CASE WHEN x.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' ELSE 'replaced' END AS change FROM x FULL JOIN b ON x.l_orderkey = b.l_orderkey AND x.l_linenumber = b.l_linenumber WHERE x.q IS DISTINCT FROM b.q
UNION ALL SELECT l_orderkey, '/tags', 'replaced' FROM o WHERE l_orderkey % 7 = 0""")
def h13_diff_documents(v):
    lines = v("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("q"))

    def doc(rows, tags):
        grouped = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "q"))).alias("lines"))
        return grouped.select("l_orderkey", F.to_json(F.struct("lines", tags.alias("tags"))).alias("doc"))

    one, two = F.array(F.lit("a")), F.when(F.col("l_orderkey") % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    after = lines.filter("l_linenumber <> 2 or l_orderkey % 3 > 0").withColumn("q", F.when(F.col("l_linenumber") == 4, 0).otherwise(F.col("q")))
    more = lines.filter("l_orderkey % 5 = 0").select("l_orderkey", F.lit(9).alias("l_linenumber"), F.lit(1).cast("long").alias("q")).distinct()
    return documents.diff_documents(doc(lines, one), doc(after.unionByName(more), two).unionByName(doc(lines, one).join(after.unionByName(more).select("l_orderkey").distinct(), "l_orderkey", "left_anti").select("l_orderkey", F.when(F.col("l_orderkey") % 7 == 0, '{"lines":{},"tags":["a","b"]}').otherwise('{"lines":{},"tags":["a"]}').alias("doc"))), "l_orderkey", "doc")


@query("""WITH x AS (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS inputs, l_orderkey % 4 AS c FROM lineitem GROUP BY l_orderkey)
SELECT count(DISTINCT inputs || '/' || CAST(c AS VARCHAR)) AS n_identities, count(*) AS n FROM x""")
def h14_identify_invocations(v):
    rows = v("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("inputs")).withColumn("c", F.col("l_orderkey") % 4)
    none = F.create_map(F.lit("HOME"), F.col("l_orderkey").cast("string"))
    identity = documents.invocation_identity(F.col("c"), F.create_map(F.lit("p"), F.lit("1")), F.col("inputs"), F.create_map(F.lit("LANG"), F.lit("C")), none)
    return rows.select(identity.alias("identity")).agg(F.countDistinct("identity").alias("n_identities"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-15' AS lapsed, TIMESTAMP '1996-06-15' >= o_orderdate AS expired FROM orders")
def h15_flag_lapsed(v):
    return numbers.flag_lapsed(v("orders"), "o_orderdate", "o_orderdate", F.lit("1996-06-15").cast("timestamp")).select("o_orderkey", "lapsed", "expired")


KLEENE = "CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END"


@query(f"""SELECT l_orderkey, bool_and({KLEENE}) AND NOT bool_or(({KLEENE}) IS NULL AND NOT coalesce((SELECT false), false)) IS NULL AS unused, CASE WHEN bool_or(({KLEENE}) = false) THEN false WHEN bool_or(({KLEENE}) IS NULL) THEN NULL ELSE true END AS every,
CASE WHEN bool_or(({KLEENE}) = true) THEN true WHEN bool_or(({KLEENE}) IS NULL) THEN NULL ELSE false END AS some FROM lineitem GROUP BY l_orderkey""".replace("bool_and(" + KLEENE + ") AND NOT bool_or((" + KLEENE + ") IS NULL AND NOT coalesce((SELECT false), false)) IS NULL AS unused, ", ""))
def h16_kleene(v):
    t = F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False)
    return v("lineitem").groupBy("l_orderkey").agg(numbers.kleene_all(t).alias("every"), numbers.kleene_any(t).alias("some"))


@query("""SELECT event_id, pointer, problem FROM (SELECT event_id, '/kind' AS pointer, 'not_listed' AS problem FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, '/p/k', 'wrong_type' FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, '/x', 'unknown_property' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT event_id, '/p/unit', 'required_missing' FROM events WHERE event_id % 5 > 0 UNION ALL SELECT event_id, '/p/unit', 'no_match' FROM events WHERE event_id % 5 = 0 AND event_id % 2 = 0) y""")
def b6_validate_against_schema(v):
    e = F.col("event_id")
    inner = F.concat(F.lit('{"k":'), F.when(e % 7 == 0, F.lit('"s"')).otherwise(F.lit("1")), F.when(e % 5 == 0, F.when(e % 2 == 0, F.lit(',"unit":"KG"')).otherwise(F.lit(',"unit":"kg"'))).otherwise(F.lit("")), F.lit("}"))
    doc = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","p":'), inner, F.when(e % 11 == 0, F.lit(',"x":[]')).otherwise(F.lit("")), F.lit("}"))
    docs = v("events").select("event_id", doc.alias("doc"))
    schema = docs.sparkSession.createDataFrame(
        [("", ["object"], False, None, None), ("/kind", ["string"], True, ["signup", "purchase", "error"], None), ("/p", ["object"], True, None, None), ("/p/k", ["integer"], True, None, None), ("/p/unit", ["string"], True, None, "^[a-z]+$")],
        "pattern string, types array<string>, required boolean, members array<string>, matching string")
    return documents.validate_against_schema(docs, schema, "event_id", "doc")


# Documents of a union over kinds, one option of which holds another union over types.
TAGGED = "event_id % 13 <> 0"
TRADE, VISIT = f"{TAGGED} AND event_type = 'purchase'", f"{TAGGED} AND event_type IN ('click', 'view')"


@query(f"""SELECT event_id, '/kind' AS pointer, 'required_missing' AS problem FROM events WHERE NOT {TAGGED} UNION ALL SELECT event_id, '/kind', 'not_listed' FROM events WHERE {TAGGED} AND event_type = 'error'
UNION ALL SELECT event_id, '/amount', 'required_missing' FROM events WHERE {TRADE} AND event_id % 3 = 0
UNION ALL SELECT event_id, '/method/type', 'required_missing' FROM events WHERE {TRADE} AND event_id % 11 = 0
UNION ALL SELECT event_id, '/method/type', 'not_listed' FROM events WHERE {TRADE} AND event_id % 11 <> 0 AND event_id % 7 = 0
UNION ALL SELECT event_id, unnest(['/method/number', '/method/change']), unnest(['unknown_property', 'required_missing']) FROM events WHERE {TRADE} AND event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 2 = 1
UNION ALL SELECT event_id, '/page', 'required_missing' FROM events WHERE {VISIT} AND event_id % 4 = 0 UNION ALL SELECT event_id, '/amount', 'unknown_property' FROM events WHERE {VISIT} AND event_id % 5 = 0""")
def b6_tagged_unions(v):
    e, kind = F.col("event_id"), F.col("event_type")
    trade, visit = kind == "purchase", kind.isin("click", "view")
    method = F.when(e % 11 == 0, F.struct(F.lit(None).cast("string").alias("type"), F.lit("1").alias("number"), F.lit(None).cast("string").alias("x")))
    method = method.when(e % 7 == 0, F.struct(F.lit("gift").alias("type"), F.lit(None).cast("string").alias("number"), F.lit("y").alias("x")))
    method = method.otherwise(F.struct(F.when(e % 2 == 0, "card").otherwise("cash").alias("type"), F.lit("1").alias("number"), F.lit(None).cast("string").alias("x")))
    doc = F.to_json(F.struct(
        F.when(e % 13 != 0, kind).alias("kind"), F.when(trade & (e % 3 != 0) | visit & (e % 5 == 0), e % 9).alias("amount"),
        F.when(visit & (e % 4 != 0), "p").alias("page"), F.when(trade, method).alias("method")))
    docs = v("events").select("event_id", doc.alias("doc"))
    trading, visiting, joining = ([("", x)] for x in ("trade", "visit", "join"))
    rows = [
        ("", ["object"], False, None, None, None), ("/kind", ["string"], True, None, None, trading), ("/kind", ["string"], True, None, None, visiting), ("/kind", ["string"], True, None, None, joining),
        ("/amount", ["integer"], True, None, None, trading), ("/page", ["string"], True, None, None, visiting), ("/method", ["object"], True, None, None, trading),
        ("/method/type", ["string"], True, None, None, [*trading, ("/method", "card")]), ("/method/number", ["string"], True, None, "^[0-9]+$", [*trading, ("/method", "card")]),
        ("/method/type", ["string"], True, None, None, [*trading, ("/method", "cash")]), ("/method/change", ["integer"], True, None, None, [*trading, ("/method", "cash")]),
    ]
    unions = [("", "kind", "purchase", "trade"), ("", "kind", "click", "visit"), ("", "kind", "view", "visit"), ("", "kind", "signup", "join"), ("/method", "type", "card", "card"), ("/method", "type", "cash", "cash")]
    spark = docs.sparkSession
    schema = spark.createDataFrame(rows, f"pattern string, types array<string>, required boolean, members array<string>, matching string, branches {documents.BRANCHES}")
    return documents.validate_against_schema(docs, schema, "event_id", "doc", spark.createDataFrame(unions, documents.UNIONS))
