"""The scalar functions by SQL names, for one session: ``register(spark)``.

Each is a SQL function of an expression, which the optimiser puts in place of the call; only the comparison of
rationals whose cross products exceed 38 digits and the check of Unicode normal form reach Python.  Tests hold
every one against its column form.  Aggregates need no names: ``kleene_all`` of a column is
``CASE WHEN bool_and(coalesce(x, false)) THEN true WHEN bool_or(NOT x) THEN false END``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from assayer.functions import documents, numbers, udtfs

RATIONAL = "STRUCT<num: DECIMAL(38,0), den: DECIMAL(38,0)>"
INTERVAL = "STRUCT<lower: DECIMAL(38,0), upper: DECIMAL(38,0), kind: STRING>"
PAIR, INTERVALS = f"a {RATIONAL}, b {RATIONAL}", f"a {INTERVAL}, b {INTERVAL}"
EXPONENT = "regexp_extract(t, r'[eE][+-]?([0-9]+)$', 1)"
CORNERS = [f"try_multiply(a.{x}, b.{y})" for x in ("lower", "upper") for y in ("lower", "upper")]


def _bounds(lower: str, upper: str, kind: str) -> str:
    return f"named_struct('lower', CAST({lower} AS DECIMAL(38,0)), 'upper', CAST({upper} AS DECIMAL(38,0)), 'kind', {kind})"


#: name, parameters, type, expression; a function may use those before it.
FUNCTIONS = [
    ("is_authored_decimal", "t STRING", "BOOLEAN", f"t IS NOT NULL AND t RLIKE r'{numbers.AUTHORED}'"),
    ("number_problem", "t STRING", "STRING", f"""CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN length(t) > {numbers.MOST_TEXT} THEN 'resource_limit' WHEN startswith(t, '+') THEN 'leading_plus'
        WHEN NOT is_authored_decimal(t) THEN 'syntax' WHEN length(trim(LEADING '0' FROM {EXPONENT})) > 4 OR try_cast({EXPONENT} AS INT) > {numbers.MOST_EXPONENT} THEN 'exponent_limit' END"""),
    ("decimal_parts", "t STRING", "STRUCT<kept: STRING, place: INT>", """transform(array(named_struct('whole', regexp_extract(t, r'^-?([0-9]+)', 1), 'part', regexp_extract(t, r'\\.([0-9]+)', 1),
        'exponent', coalesce(try_cast(regexp_extract(t, r'[eE]([+-]?[0-9]+)$', 1) AS INT), 0))), p -> named_struct('kept', trim(BOTH '0' FROM concat(p.whole, p.part)),
        'place', length(trim(LEADING '0' FROM concat(p.whole, p.part))) - length(p.part) + p.exponent))[0]"""),
    ("lower_decimal", "t STRING", "STRING", """CASE WHEN number_problem(t) IS NULL THEN transform(array(decimal_parts(t)), p -> CASE WHEN p.kept = '' THEN '0' ELSE concat(CASE WHEN startswith(t, '-') THEN '-' ELSE '' END,
        CASE WHEN p.place <= 0 THEN concat('0.', repeat('0', -p.place), p.kept) WHEN p.place >= length(p.kept) THEN concat(p.kept, repeat('0', p.place - length(p.kept)))
        ELSE concat(substring(p.kept, 1, p.place), '.', substring(p.kept, p.place + 1)) END) END)[0] END"""),
    ("is_canonical", "t STRING", "BOOLEAN", "coalesce(lower_decimal(t) = t, false)"),
    ("rational", "num DECIMAL(38,0), den DECIMAL(38,0)", RATIONAL, "named_struct('num', num, 'den', den)"),
    ("whole_rational", "num DECIMAL(38,0), den DECIMAL(38,0)", RATIONAL, "CASE WHEN num IS NOT NULL AND den IS NOT NULL THEN rational(num, den) END"),
    ("decimal_to_rational", "t STRING", RATIONAL, r"""rational(try_cast(replace(t, '.', '') AS DECIMAL(38,0)), try_cast(concat('1', repeat('0', length(regexp_extract(t, r'\.([0-9]+)$', 1)))) AS DECIMAL(38,0)))"""),
    ("exact_add", PAIR, RATIONAL, """whole_rational(CASE WHEN a.den = b.den THEN try_add(a.num, b.num) ELSE try_add(try_multiply(a.num, b.den), try_multiply(b.num, a.den)) END,
        CASE WHEN a.den = b.den THEN a.den ELSE try_multiply(a.den, b.den) END)"""),
    ("exact_sub", PAIR, RATIONAL, "exact_add(a, rational(CAST(0 AS DECIMAL(38,0)) - b.num, b.den))"),
    ("exact_mul", PAIR, RATIONAL, "whole_rational(try_multiply(a.num, b.num), try_multiply(a.den, b.den))"),
    ("exact_div", PAIR, RATIONAL, """CASE WHEN b.num > 0 THEN exact_mul(a, rational(b.den, b.num))
        WHEN b.num < 0 THEN exact_mul(a, rational(CAST(0 AS DECIMAL(38,0)) - b.den, CAST(0 AS DECIMAL(38,0)) - b.num)) END"""),
    ("exact_cmp", PAIR, "INT", """CASE WHEN signum(a.num) < signum(b.num) THEN -1 WHEN signum(a.num) > signum(b.num) THEN 1
        WHEN try_multiply(a.num, b.den) < try_multiply(b.num, a.den) THEN -1 WHEN try_multiply(a.num, b.den) > try_multiply(b.num, a.den) THEN 1
        WHEN try_multiply(a.num, b.den) = try_multiply(b.num, a.den) THEN 0 ELSE far_cmp(CASE WHEN try_multiply(a.num, b.den) IS NULL OR try_multiply(b.num, a.den) IS NULL THEN CAST(a.num AS STRING) END, CAST(a.den AS STRING), CAST(b.num AS STRING), CAST(b.den AS STRING)) END"""),
    ("value_in_unit", f"value {RATIONAL}, factor {RATIONAL}", RATIONAL, "exact_div(value, factor)"),
    ("exact_interval", "lower DECIMAL(38,0), upper DECIMAL(38,0), kind STRING", INTERVAL, "named_struct('lower', lower, 'upper', upper, 'kind', kind)"),
    ("whole_interval", f"i {INTERVAL}", INTERVAL, "CASE WHEN i.lower IS NOT NULL AND i.upper IS NOT NULL AND i.kind IS NOT NULL THEN i END"),
    ("interval_add", INTERVALS, INTERVAL, f"CASE WHEN a.kind = b.kind THEN whole_interval({_bounds('try_add(a.lower, b.lower)', 'try_add(a.upper, b.upper)', 'a.kind')}) END"),
    ("interval_sub", INTERVALS, INTERVAL, f"CASE WHEN a.kind = b.kind THEN whole_interval({_bounds('try_subtract(a.lower, b.upper)', 'try_subtract(a.upper, b.lower)', 'a.kind')}) END"),
    ("interval_mul", f"{INTERVALS}, kind STRING", INTERVAL, f"""CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in CORNERS)}
        THEN whole_interval({_bounds(f"least({', '.join(CORNERS)})", f"greatest({', '.join(CORNERS)})", 'kind')}) END"""),
    ("kleene_and", "a BOOLEAN, b BOOLEAN", "BOOLEAN", "a AND b"),
    ("kleene_or", "a BOOLEAN, b BOOLEAN", "BOOLEAN", "a OR b"),
    ("kleene_not", "a BOOLEAN", "BOOLEAN", "NOT a"),
    ("timestamp_lapsed", "deadline TIMESTAMP, now TIMESTAMP", "BOOLEAN", "deadline < now"),
    ("not_after_passed", "not_after TIMESTAMP, at TIMESTAMP", "BOOLEAN", "at >= not_after"),
    ("json_problem", "t STRING", "STRING", f"""CASE WHEN try_parse_json(t) IS NULL THEN 'not_json' WHEN regexp_replace(t, r'{documents.STRINGS}', '""') RLIKE r'[0-9]\\.[0-9]|[0-9][eE]' THEN 'not_an_integer'
        WHEN exists(regexp_extract_all(regexp_replace(t, r'{documents.STRINGS}', '""'), '-?[0-9]+', 0), n -> coalesce(abs(try_cast(n AS DECIMAL(38,0))) > {documents.SAFE_INTEGER}, true)) THEN 'integer_range'
        WHEN NOT is_nfc(t) THEN 'not_nfc' END"""),
    ("canonical_json", "t STRING", "STRING", "CASE WHEN json_problem(t) IS NULL THEN to_json(try_parse_json(t)) END"),
    ("content_identity", "canonical STRING", "STRING", "concat('sha256:', sha2(canonical, 256))"),
    ("design_signature", "items ARRAY<STRUCT<item: STRING, amount: STRING>>", "STRING", "array_join(transform(items, i -> concat(i.item, ':', i.amount)), '|')"),
]


def register(spark: SparkSession) -> None:
    """Make all scalar functions and the table functions callable from the session's SQL; calling it again changes nothing."""
    spark.udf.register("far_cmp", numbers.far_cmp())
    spark.udf.register("is_nfc", documents.nfc_check())
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    udtfs.register(spark)
