"""Exact numbers as columns: authored decimals, rationals as pairs of 38-digit integers, intervals.

A rational is a struct ``num, den`` of DECIMAL(38,0) with a positive denominator.  Results beyond 38
digits are null, which callers report as ``resource_limit``; nothing is ever rounded on the way.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"
AUTHORED = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
#: Largest exponent and longest text that an authored number may have.
MOST_EXPONENT, MOST_TEXT = 4096, 16384


def number_problem(text: Column) -> Column:
    """Why a text is no authored decimal; null if it is one."""
    exponent = F.regexp_extract(text, r"[eE][+-]?([0-9]+)$", 1)
    return (
        F.when(text.isNull() | (text == ""), "empty").when(F.length(text) > MOST_TEXT, "resource_limit").when(text.startswith("+"), "leading_plus")
        .when(~text.rlike(AUTHORED), "syntax").when((F.length(F.ltrim(exponent, F.lit("0"))) > 4) | (exponent.try_cast("int") > MOST_EXPONENT), "exponent_limit")
    )


def _pieces(text: Column) -> dict[str, Column]:
    """Digits before and behind the point, and the exponent."""
    return {
        "whole": F.regexp_extract(text, r"^-?([0-9]+)", 1), "part": F.regexp_extract(text, r"\.([0-9]+)", 1),
        "exponent": F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0)),
    }


def _place(whole: Column, exponent: Column, digits: Column, lead: Column) -> Column:
    """Where the point stands behind the first digit that is not zero."""
    return F.length(whole) + exponent - (F.length(digits) - F.length(lead))


def _plain(text: Column, problem: Column, place: Column, kept: Column) -> Column:
    """The canonical text of significant digits with the point at a place."""
    n = F.length(kept)
    plain = (
        F.when(place <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), kept))
        .when(place >= n, F.concat(kept, F.repeat(F.lit("0"), place - n)))
        .otherwise(F.concat(F.substring(kept, F.lit(1), place), F.lit("."), F.substring(kept, place + 1, n)))
    )
    good = problem.isNull()
    return F.when(good & (kept == ""), "0").when(good, F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain))


def lower_decimal(text: Column) -> Column:
    """An authored decimal, exponent and all, as canonical plain decimal; null if it is none."""
    p = _pieces(text)
    digits = F.concat(p["whole"], p["part"])
    lead = F.ltrim(digits, F.lit("0"))
    return _plain(text, number_problem(text), _place(p["whole"], p["exponent"], digits, lead), F.rtrim(lead, F.lit("0")))


def is_canonical(text: Column) -> Column:
    return F.coalesce(lower_decimal(text) == text, F.lit(False))


def with_lowered(df: DataFrame, column: str, out: str, problem: str | None = None) -> DataFrame:
    """``df`` with :func:`lower_decimal` of a text column as ``out``, and what is wrong with it as ``problem``.

    Each part is a column before it is looked at twice, so that the expression does not multiply.
    """
    c, p = F.col(column), {k: f"__{out}_{k}" for k in ("problem", "whole", "part", "exponent", "digits", "lead", "place", "kept")}
    df = df.withColumns({p["problem"]: number_problem(c), **{p[k]: piece for k, piece in _pieces(c).items()}})
    df = df.withColumn(p["digits"], F.concat(p["whole"], p["part"]))
    df = df.withColumn(p["lead"], F.ltrim(p["digits"], F.lit("0")))
    place = _place(*[F.col(p[k]) for k in ("whole", "exponent", "digits", "lead")])
    df = df.withColumns({p["place"]: place, p["kept"]: F.rtrim(p["lead"], F.lit("0"))})
    lowered = _plain(c, F.col(p["problem"]), F.col(p["place"]), F.col(p["kept"]))
    found = {out: lowered} if problem is None else {out: lowered, problem: F.col(p["problem"])}
    return df.withColumns(found).drop(*p.values())


def normalize_numbers(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``canonical``, ``is_canonical`` and ``number_problem`` of a text column."""
    out = with_lowered(df, column, "canonical", "number_problem")
    return out.withColumn("is_canonical", F.coalesce(F.col("canonical") == F.col(column), F.lit(False)))


def rational(num: Column, den: Column) -> Column:
    return F.struct(num.cast(EXACT).alias("num"), den.cast(EXACT).alias("den"))


def decimal_to_rational(text: Column) -> Column:
    """A canonical decimal as a (not reduced) rational; null beyond 38 digits."""
    part = F.regexp_extract(text, r"\.([0-9]+)$", 1)
    return rational(F.replace(text, F.lit("."), F.lit("")).try_cast(EXACT), F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(part))).try_cast(EXACT))


def _checked(num: Column, den: Column) -> Column:
    return F.when(num.isNotNull() & den.isNotNull(), rational(num, den))


def _mul(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).cast(EXACT)


def _minus(a: Column) -> Column:
    """The sign of a decimal of more than 34 digits changes by subtraction: ``-`` and ``abs`` round it."""
    return (F.lit(0).cast(EXACT) - a).cast(EXACT)


def _size(a: Column) -> Column:
    return F.when(a < 0, _minus(a)).otherwise(a)


def exact_add(a: Column, b: Column) -> Column:
    same = a["den"] == b["den"]
    num = F.when(same, F.try_add(a["num"], b["num"])).otherwise(F.try_add(_mul(a["num"], b["den"]), _mul(b["num"], a["den"])))
    return _checked(num.cast(EXACT), F.when(same, a["den"]).otherwise(_mul(a["den"], b["den"])))


def negated(a: Column) -> Column:
    return rational(_minus(a["num"]), a["den"])


def exact_sub(a: Column, b: Column) -> Column:
    return exact_add(a, negated(b))


def exact_mul(a: Column, b: Column) -> Column:
    return _checked(_mul(a["num"], b["num"]), _mul(a["den"], b["den"]))


def exact_div(a: Column, b: Column) -> Column:
    """Null for a zero divisor too; the sign stays in the numerator."""
    flip = F.when(b["num"] < 0, -1).otherwise(1).cast(EXACT)
    return F.when(b["num"] != 0, _checked(_mul(_mul(a["num"], b["den"]), flip), _mul(a["den"], _size(b["num"]))))


def _named(value: Column, use) -> Column:
    """``use`` of a value that is found once: the array of one names it."""
    return F.transform(F.array(value), use)[0]


def _divisor(x: Column, y: Column, kind: str, steps: tuple[int, ...]) -> Column:
    """Greatest common divisor by Euclid's algorithm.  Most pairs are done in the first steps; later ones run where it is open."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).cast(kind).alias("y")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps[0])), F.struct(x.cast(kind).alias("x"), y.cast(kind).alias("y")), step)
    if len(steps) == 1:
        return end["x"]
    return _named(end, lambda s: F.when(s["y"] == 0, s["x"]).otherwise(_divisor(s["x"], s["y"], kind, steps[1:])))


def _long_lowest(r: Column) -> Column:
    """The lowest terms of a rational of at most 18 digits, in 64-bit integers (90 steps serve them)."""
    num, den = r["num"].cast("long"), r["den"].cast("long")
    whole = lambda n, g: F.call_function("div", n, g)
    return _named(_divisor(F.abs(num), den, "long", (16, 74)), lambda g: rational(whole(num, g), whole(den, g)))


def _wide_lowest(r: Column) -> Column:
    """The lowest terms of a rational of up to 38 digits (184 steps serve them)."""
    half = F.lit("1" + "0" * 19).cast(EXACT)

    def whole(n: Column, d: Column) -> Column:
        return F.try_divide((n - n % d).cast(EXACT), d).cast(EXACT)

    def divide(n: Column, d: Column) -> Column:
        # Spark's division keeps 32 digits of a quotient.  A longer one has a divisor below 10**6: then two
        # halves of 19 digits are divided one after the other, the first one's rest going before the second.
        high, low = whole(n, half), (n % half).cast(EXACT)
        long = F.try_add(_mul(whole(high, d), half), whole(F.try_add(_mul((high % d).cast(EXACT), half), low).cast(EXACT), d)).cast(EXACT)
        return F.when(d < 10**6, long).otherwise(whole(n, d))

    def lowest(g: Column) -> Column:
        return _named(divide(_size(r["num"]), g), lambda num: rational(F.when(r["num"] < 0, _minus(num)).otherwise(num), divide(r["den"], g)))

    return _named(_divisor(_size(r["num"]), r["den"], EXACT, (16, 32, 136)), lowest)


def reduced(a: Column) -> Column:
    """A rational in lowest terms."""
    short = F.lit("1" + "0" * 18).cast(EXACT)

    def lowest(r: Column) -> Column:
        fits = (r["num"] < short) & (r["num"] > _minus(short)) & (r["den"] < short)
        terms = F.when(r["num"] == 0, rational(F.lit(0), F.lit(1))).when(fits, _long_lowest(r)).otherwise(_wide_lowest(r))
        return F.when(r.isNotNull(), terms)

    return _named(a, lowest)


def far_cmp():
    """The comparison of rationals by whole integers, given as four texts; null for null."""

    def one(w, x, y, z):
        if None in (w, x, y, z):
            return None
        a, b = Fraction(int(w), int(x)), Fraction(int(y), int(z))
        return (a > b) - (a < b)

    def whole(an: pd.Series, ad: pd.Series, bn: pd.Series, bd: pd.Series) -> pd.Series:
        return pd.Series([one(*q) for q in zip(an, ad, bn, bd)], dtype="Int32")

    return F.pandas_udf(whole, "int")


def exact_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1; by signs, then by cross products, and by whole integers only where those exceed 38 digits."""
    sa, sb = F.signum(a["num"]), F.signum(b["num"])
    left, right = _mul(a["num"], b["den"]), _mul(b["num"], a["den"])
    over = left.isNull() | right.isNull()
    text = lambda c: F.when(over & (sa == sb), c.cast("string"))

    far = far_cmp()(text(a["num"]), text(a["den"]), text(b["num"]), text(b["den"]))
    return F.when(sa != sb, F.when(sa < sb, -1).otherwise(1)).when(~over, F.when(left < right, -1).when(left > right, 1).otherwise(0)).otherwise(far)


def half_even_round(value: Column, scale: int) -> Column:
    """A decimal rounded half to even at a scale."""
    return F.bround(value, scale)


def fixed_decimal(value: Column, scale: int) -> Column:
    """A decimal as text with exactly ``scale`` digits behind the point, rounded half to even."""
    return F.bround(value, scale).cast(f"decimal(38,{scale})").cast("string")


def value_in_unit(num: Column, den: Column, factor_num: Column, factor_den: Column) -> Column:
    """A canonical value as rational of a unit, given the unit's factor."""
    return exact_div(rational(num, den), rational(factor_num, factor_den))


def interval(lower: Column, upper: Column, kind: Column) -> Column:
    return F.struct(lower.alias("lower"), upper.alias("upper"), kind.alias("kind"))


def interval_add(a: Column, b: Column) -> Column:
    """Null if kinds differ or a bound overflows."""
    out = interval(F.try_add(a["lower"], b["lower"]), F.try_add(a["upper"], b["upper"]), a["kind"])
    return F.when((a["kind"] == b["kind"]) & out["lower"].isNotNull() & out["upper"].isNotNull(), out)


def interval_sub(a: Column, b: Column) -> Column:
    """Bounds cross: the least is a's lower minus b's upper."""
    out = interval(F.try_subtract(a["lower"], b["upper"]), F.try_subtract(a["upper"], b["lower"]), a["kind"])
    return F.when((a["kind"] == b["kind"]) & out["lower"].isNotNull() & out["upper"].isNotNull(), out)


def interval_mul(a: Column, b: Column, product_kind: Column) -> Column:
    """Least and greatest of the four products; the kind comes from a table of products."""
    corners = [F.try_multiply(a[x], b[y]) for x in ("lower", "upper") for y in ("lower", "upper")]
    whole = corners[0].isNotNull() & corners[1].isNotNull() & corners[2].isNotNull() & corners[3].isNotNull()
    return F.when(whole & product_kind.isNotNull(), interval(F.least(*corners), F.greatest(*corners), product_kind))


def combine_intervals(df: DataFrame, products: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``df`` with ``sum``, ``difference`` and ``product`` of two interval columns; ``products(kind_a, kind_b, kind)`` is small."""
    kinds = products.select(F.col("kind_a").alias("__a"), F.col("kind_b").alias("__b"), F.col("kind").alias("__kind"))
    rows = df.join(kinds, (F.col(f"{a}.kind") == F.col("__a")) & (F.col(f"{b}.kind") == F.col("__b")), "left")
    x, y = F.col(a), F.col(b)
    return rows.withColumns({"sum": interval_add(x, y), "difference": interval_sub(x, y), "product": interval_mul(x, y, F.col("__kind"))}).drop("__a", "__b", "__kind")


def kleene_and(a: Column, b: Column) -> Column:
    return a & b


def kleene_or(a: Column, b: Column) -> Column:
    return a | b


def kleene_not(a: Column) -> Column:
    return ~a


def kleene_all(truth: Column) -> Column:
    """Aggregate: false if any is false, else null if any is null.  Plain ``every`` would skip nulls."""
    least = F.min(F.when(truth.isNull(), 1).when(truth, 2).otherwise(0))
    return F.when(least == 2, True).when(least == 0, False)


def kleene_any(truth: Column) -> Column:
    most = F.max(F.when(truth.isNull(), 1).when(truth, 2).otherwise(0))
    return F.when(most == 2, True).when(most == 0, False)


def timestamp_lapsed(deadline: Column, now: Column) -> Column:
    """A response deadline lapses after it."""
    return deadline < now


def not_after_passed(not_after: Column, at: Column) -> Column:
    """A validity end counts from its own instant on."""
    return at >= not_after


def flag_lapsed(df: DataFrame, deadline: str, not_after: str, now: Column) -> DataFrame:
    return df.withColumns({"lapsed": timestamp_lapsed(F.col(deadline), now), "expired": not_after_passed(F.col(not_after), now)})
