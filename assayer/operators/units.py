"""Units: scaling into a kind's canonical unit and checks of unit tables.

``kinds(kind, unit, factor_num, factor_den)`` has one row per unit; a factor says how many canonical
units one unit is.  Unit tables are small by nature and Spark broadcasts them when they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"


def scale_units(df: DataFrame, kinds: DataFrame, value: str = "value", kind: str = "kind", unit: str = "unit") -> DataFrame:
    """``df`` with ``scaled_num / scaled_den``, ``canonical_unit``, ``unit_problem`` and ``unit_candidates``.

    A unit that only other kinds have is told apart from one that none has; for the latter the kind's own
    units are the candidates.  A product beyond 38 digits becomes null with problem ``resource_limit``.
    """
    canonical = kinds.filter("factor_num = factor_den").groupBy("kind").agg(F.min("unit").alias("canonical_unit"))
    own = kinds.groupBy("kind").agg(F.array_sort(F.collect_set("unit")).alias("__own")).join(canonical, "kind", "left").withColumnRenamed("kind", kind)
    anywhere = kinds.select(F.col("unit").alias(unit)).distinct().withColumn("__anywhere", F.lit(True))
    factors = kinds.select(F.col("kind").alias(kind), F.col("unit").alias(unit), "factor_num", "factor_den")
    out = df.join(factors, [kind, unit], "left").join(own, kind, "left").join(anywhere, unit, "left")
    number = F.try_multiply(F.col(value).cast(EXACT), F.col("factor_num").cast(EXACT))
    problem = (
        F.when(F.col("__own").isNull(), "unknown_kind")
        .when(F.col("factor_num").isNull() & F.col("__anywhere").isNotNull(), "other_kind_unit")
        .when(F.col("factor_num").isNull(), "unknown_unit")
        .when(F.col(value).isNotNull() & number.isNull(), "resource_limit")
    )
    candidates = F.when(problem == "unknown_unit", F.col("__own"))
    return out.select(df["*"], number.alias("scaled_num"), F.col("factor_den").cast(EXACT).alias("scaled_den"), "canonical_unit", problem.alias("unit_problem"), candidates.alias("unit_candidates"))


def check_kinds(kinds: DataFrame) -> DataFrame:
    """``kind, problem``: units listed twice, no unit of factor one, factors that are not positive."""
    seen = kinds.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.expr("factor_num = factor_den")).alias("canonical"), F.bool_or(F.expr("factor_num <= 0 or factor_den <= 0")).alias("bad"))
    by = seen.groupBy("kind").agg(F.bool_or(F.col("n") > 1).alias("twice"), F.bool_or("canonical").alias("canonical"), F.bool_or("bad").alias("bad"))
    return violations(by, ["kind"], {"duplicate_unit": F.col("twice"), "no_canonical_unit": ~F.col("canonical"), "factor_not_positive": F.col("bad")})


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """``keys, problem``: a row for each rule that holds for a row; rules may hold together."""
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return df.select(*keys, F.explode(found).alias("problem"))
