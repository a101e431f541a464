"""Functions by their SQL names against their column forms."""

import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assayer.functions import documents, numbers, sql

BIG = 10**37 * 9 + 7
TEXTS = ["0", "-0", "1e3", "12.50", "0.001", "-1.20e-4", "00", "007.10", "1.", "+1", "", None, "1e9999", "1e4096", "1e00004", "-0.0e5", "123456789012345678901234567890.5", "5E+2", "abc", "9" * 50]
RATIONALS = [(1, 2), (-1, 3), (0, 5), (7, 7), (BIG, 1), (BIG, BIG - 2), (-BIG, 3), (BIG - 2, BIG), (3, 10**20), None]
INTERVALS = [(-2, 3, "m"), (1, 5, "m"), (-4, -1, "s"), (0, BIG, "m"), None]
DOCUMENTS = ['{"b":1,"a":[true,null]}', '{"a":1.0}', '{"a":"1.0 \\" 2.5"}', '{"a":1e3}', "{", '{"a":9007199254740992}', '{"a":"é"}', '{"a":"é"}', None, '{"a":1,"a":2}']


@pytest.fixture(scope="module")
def registered(spark):
    sql.register(spark)
    sql.register(spark)  # again, without harm
    return spark


def differing(df, named, column):
    return df.withColumns({"by_name": F.expr(named), "by_column": column}).filter("NOT (by_name <=> by_column)").collect()


@pytest.mark.parametrize("name", ["number_problem", "lower_decimal", "is_canonical"])
def test_numbers(registered, name):
    df = registered.createDataFrame([(t,) for t in TEXTS], "t string")
    assert not differing(df, f"{name}(t)", getattr(numbers, name)(F.col("t")))
    assert df.filter(F.expr(f"{name}(t)").isNotNull()).count() > 1


@pytest.mark.parametrize("name", ["exact_add", "exact_sub", "exact_mul", "exact_div", "exact_cmp"])
def test_rationals(registered, name):
    number = lambda r: None if r is None else (Decimal(r[0]), Decimal(r[1]))
    pairs = [(number(a), number(b)) for a, b in itertools.product(RATIONALS, RATIONALS)]
    df = registered.createDataFrame(pairs, f"a {sql.RATIONAL}, b {sql.RATIONAL}")
    assert not differing(df, f"{name}(a, b)", getattr(numbers, name)(F.col("a"), F.col("b")))
    assert df.filter(F.expr(f"{name}(a, b)").isNotNull()).count() >= 20  # pairs of the five small ones, but for divisions by zero


def test_intervals(registered):
    number = lambda i: None if i is None else (Decimal(i[0]), Decimal(i[1]), i[2])
    df = registered.createDataFrame([(number(a), number(b)) for a, b in itertools.product(INTERVALS, INTERVALS)], f"a {sql.INTERVAL}, b {sql.INTERVAL}")
    a, b = F.col("a"), F.col("b")
    for named, column in (("interval_add(a, b)", numbers.interval_add(a, b)), ("interval_sub(a, b)", numbers.interval_sub(a, b)), ("interval_mul(a, b, 'k')", numbers.interval_mul(a, b, F.lit("k"))), ("interval_mul(a, b, NULL)", numbers.interval_mul(a, b, F.lit(None).cast("string")))):
        both = df.withColumns({"x": F.expr(named), "y": column})
        assert both.filter("NOT (x.lower <=> y.lower AND x.upper <=> y.upper AND x.kind <=> y.kind)").count() == 0


def test_documents(registered):
    df = registered.createDataFrame([(t,) for t in DOCUMENTS], "t string")
    for name in ("json_problem", "canonical_json"):
        assert not differing(df, f"{name}(t)", getattr(documents, name)(F.col("t")))
    assert not differing(df, "content_identity(t)", documents.content_identity(F.col("t")))


def test_three_values(registered):
    df = registered.createDataFrame(list(itertools.product([True, False, None], repeat=2)), "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    assert not differing(df, "kleene_and(a, b)", numbers.kleene_and(a, b)) and not differing(df, "kleene_or(a, b)", numbers.kleene_or(a, b)) and not differing(df, "kleene_not(a)", numbers.kleene_not(a))


def test_the_rest_by_example(registered):
    row = registered.sql("""SELECT value_in_unit(rational(3, 2), rational(1, 4)) AS u, decimal_to_rational('-1.25') AS r, design_signature(array(named_struct('item', 'a', 'amount', '2'), named_struct('item', 'b', 'amount', '3'))) AS s,
      (SELECT CASE WHEN bool_and(coalesce(x, false)) THEN true WHEN bool_or(NOT x) THEN false END FROM VALUES (true), (NULL), (false) AS t(x)) AS k""").first()
    assert (tuple(row.u), tuple(row.r), row.s, row.k) == ((12, 2), (-125, 100), "a:2|b:3", False)
