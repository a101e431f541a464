"""Predicate forests over contexts in three-valued logic.

A rule is a tree of nodes; leaves are joined with the contexts' values, and truth is folded towards the
root one level at a time.  Codes: 0 false, 1 unknown, 2 true, so ``all`` is the least, ``any`` the
greatest and ``not`` two minus the code of a node's child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers
from assayer.storage import materialize


def code(truth: Column) -> Column:
    return F.when(truth.isNull(), 1).when(truth, 2).otherwise(0)


def truth(code_col: Column) -> Column:
    return F.when(code_col == 2, True).when(code_col == 0, False)


def in_range(value: Column) -> Column:
    """Bounds are exclusive unless flagged; a null value is unknown, a null bound is none."""
    low = F.coalesce(F.when(F.col("low_inclusive"), value >= F.col("low")).otherwise(value > F.col("low")), F.col("low").isNull() | F.lit(None))
    high = F.coalesce(F.when(F.col("high_inclusive"), value <= F.col("high")).otherwise(value < F.col("high")), F.col("high").isNull() | F.lit(None))
    return F.when(value.isNotNull(), low & high)


def _ordered(op: Column, order: Column) -> Column:
    """The truth of a comparison, given -1, 0 or 1 for its sides."""
    return (
        F.when(op == "eq", order == 0).when(op == "ne", order != 0).when(op == "lt", order < 0).when(op == "le", order <= 0)
        .when(op == "gt", order > 0).when(op == "ge", order >= 0)
    )


def with_quantities(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__left`` and ``__right``, whose order is that of fact and operand in their kind's canonical unit.

    Exact; null without a factor or beyond 38 digits.
    """
    for text, num, den, out in (("text", "factor_num", "factor_den", "x"), ("operand", "operand_num", "operand_den", "y")):
        rows = numbers.with_lowered(rows, text, f"__{out}_text").withColumn(f"__{out}_value", numbers.decimal_to_rational(F.col(f"__{out}_text")))
        factor = F.when(F.col(num).isNotNull() & F.col(den).isNotNull(), numbers.rational(F.col(num), F.col(den)))
        rows = rows.withColumn(f"__{out}_factor", factor)
        rows = rows.withColumn(f"__{out}", numbers.exact_mul(F.col(f"__{out}_value"), F.col(f"__{out}_factor")))
    return rows.withColumns({"__left": F.try_multiply("__x.num", "__y.den"), "__right": F.try_multiply("__y.num", "__x.den")})


def fact_compare() -> Column:
    """A fact against an operand of the same type: quantities by exact value in their kind's canonical unit, integers
    exactly, texts and booleans only for equality.  Unlike types, and what cannot be read, are unknown.

    Looks at rows of :func:`with_quantities`.
    """
    op, text, operand = F.col("op"), F.col("text"), F.col("operand")
    a, b = (t.try_cast("decimal(38,0)") for t in (text, operand))
    integer = F.when(a.isNotNull() & b.isNotNull(), F.when(a < b, -1).when(a > b, 1).otherwise(0))
    left, right = F.col("__left"), F.col("__right")
    quantity = F.when(left.isNotNull() & right.isNotNull(), F.when(left < right, -1).when(left > right, 1).otherwise(0))
    p, q = (F.when(t.isin("true", "false"), t == "true") for t in (text, operand))  # no other spelling is a boolean
    same = F.when(F.col("type") == "string", text == operand).when(F.col("type") == "boolean", p == q)
    scalar = F.when(op == "eq", same).when(op == "ne", ~same)
    result = F.when(F.col("type") == "integer", _ordered(op, integer)).when(F.col("type") == "quantity", _ordered(op, quantity)).otherwise(scalar)
    return F.when(F.col("type") == F.col("operand_type"), result)


def leaf_truth(leaves: DataFrame, values: DataFrame, contexts: DataFrame, kinds: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``node_id, context_id, code`` of every leaf in every context of its rule, with the columns ``keep`` of the leaf.

    ``leaves(node_id, rule_id, op, name, source_class, validator, operand, operand_type, operand_unit, kind, low,
    low_inclusive, high, high_inclusive, members)``; ``values(context_id, name, source_class, validator, number,
    text, type, unit)``; ``contexts(rule_id, context_id)`` says which rules are asked in which contexts;
    ``kinds(kind, unit, factor_num, factor_den)`` scales quantities (a leaf names its fact's kind).
    """
    if kinds is None:
        kinds = leaves.sparkSession.createDataFrame([], "kind string, unit string, factor_num long, factor_den long")
    asked = leaves.join(contexts, "rule_id")
    given = values.select("context_id", "name", F.col("source_class").alias("v_class"), F.col("validator").alias("v_validator"), "number", "text", "type", "unit")
    rows = asked.join(given, ["context_id", "name"], "left")
    rows = rows.join(kinds.select("kind", "unit", "factor_num", "factor_den"), ["kind", "unit"], "left")
    own = kinds.select("kind", F.col("unit").alias("operand_unit"), F.col("factor_num").alias("operand_num"), F.col("factor_den").alias("operand_den"))
    rows = with_quantities(rows.join(own, ["kind", "operand_unit"], "left"))
    trusted = (F.col("source_class").isNull() | F.col("source_class").eqNullSafe(F.col("v_class"))) & (F.col("validator").isNull() | F.col("validator").eqNullSafe(F.col("v_validator")))
    result = (
        F.when(F.col("op") == "always", True)
        .when(F.col("op").isin("param_range", "attribute_range"), in_range(F.col("number")))
        .when(F.col("op").isin("attribute_in", "environment_in"), F.when(F.col("text").isNotNull(), F.array_contains("members", F.col("text"))))
        .otherwise(F.when(trusted, fact_compare()))
    )
    return rows.select("node_id", "context_id", *keep, code(result).alias("code"))


def evaluate_applicability(nodes: DataFrame, values: DataFrame, contexts: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``rule_id, context_id, truth`` for the rules' roots.

    ``nodes`` are leaves as above and inner nodes (``op`` all, any or not) with ``parent_id`` (null at the root)
    and ``level`` (0 at the root); an ``all`` or ``any`` without children is true or false.  Levels are folded from
    the deepest up; a truth is written once, and a level reads only the truths of the level below it.
    """
    inner = F.col("op").isin("all", "any", "not")
    depth = nodes.agg(F.max("level")).first()[0]
    leaves = materialize(leaf_truth(nodes.filter(~inner), values, contexts, kinds, ("level",)), "leaf-truth", "level")
    folds = None

    def at(level: int) -> DataFrame:
        found = leaves.filter(F.col("level") == level).select("node_id", "context_id", "code")
        return found if folds is None else found.unionByName(folds)

    for level in range(depth if depth is not None else -1, -1, -1):
        here = nodes.filter(inner & (F.col("level") == level)).select("node_id", "rule_id", "op")
        parts = nodes.filter(F.col("level") == level + 1).select(F.col("node_id").alias("child"), F.col("parent_id").alias("node_id")).join(at(level + 1).withColumnRenamed("node_id", "child"), "child")
        folded = parts.groupBy("node_id", "context_id").agg(F.min("code").alias("low"), F.max("code").alias("high"))
        asked = here.join(contexts, "rule_id").join(folded, ["node_id", "context_id"], "left")
        result = F.when(F.col("op") == "all", F.coalesce("low", F.lit(2))).when(F.col("op") == "any", F.coalesce("high", F.lit(0))).otherwise(2 - F.col("low"))
        folds = materialize(asked.select("node_id", "context_id", result.cast("int").alias("code")), "truth")
    roots = nodes.filter("parent_id is null").select("node_id", "rule_id")
    return roots.join(at(0), "node_id").select("rule_id", "context_id", truth(F.col("code")).alias("truth"))


def derive_eligibility(nodes: DataFrame, values: DataFrame, contexts: DataFrame, recorded: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``rule_id, context_id, derived, recorded, verdict``: ineligible and unknown refuse, a differing record is a failure."""
    derived = evaluate_applicability(nodes, values, contexts, kinds).select("rule_id", "context_id", F.coalesce(F.when(F.col("truth"), "eligible").when(~F.col("truth"), "ineligible"), F.lit("unknown")).alias("derived"))
    both = derived.join(recorded.select("rule_id", "context_id", F.col("outcome").alias("recorded")), ["rule_id", "context_id"], "full_outer")
    verdict = F.when(F.col("recorded").isNotNull() & ~F.col("recorded").eqNullSafe(F.col("derived")), "mismatch").when(F.col("derived") == "eligible", "accepted").otherwise("refused")
    return both.select("rule_id", "context_id", "derived", "recorded", verdict.alias("verdict"))
