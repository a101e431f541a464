"""Predicate forests against a plain fold, and what is written on the way."""

import random

from assayer.operators import predicates

NODES = """node_id int, rule_id int, parent_id int, level int, op string, name string, source_class string, validator string, operand string, operand_type string,
 operand_unit string, kind string, low double, low_inclusive boolean, high double, high_inclusive boolean, members array<string>"""
VALUES = "context_id long, name string, source_class string, validator string, number double, text string, type string, unit string"


def forest(rng, rules, deepest):
    rows, children = [], {}

    def grow(rule, parent, level):
        at = len(rows)
        op = rng.choice(["all", "any", "not", "attribute_in"]) if level < deepest else "attribute_in"
        op = "not" if rule == 0 and level < deepest else op  # rule 0 is one deep chain
        rows.append((at, rule, parent, level, op, f"n{rng.randrange(4)}", *[None] * 10, ["x", "y"]))
        children[at] = []
        for _ in range(0 if op == "attribute_in" else 1 if op == "not" else rng.randrange(4)):
            children[at].append(grow(rule, at, level + 1))
        return at

    roots = {rule: grow(rule, None, 0) for rule in range(rules)}
    return rows, children, roots


def test_forests_match_a_plain_fold(spark, monkeypatch):
    rng = random.Random(5)
    rows, children, roots = forest(rng, 12, 6)
    facts = {(c, f"n{k}"): rng.choice(["x", "z", None]) for c in range(3) for k in range(4)}

    def code(at, context):
        op, below = rows[at][4], [code(b, context) for b in children[at]]
        if op == "attribute_in":
            return {"x": 2, "z": 0, None: 1}[facts[context, rows[at][5]]]
        return min(below, default=2) if op == "all" else max(below, default=0) if op == "any" else 2 - below[0]

    nodes = spark.createDataFrame(rows, NODES)
    values = spark.createDataFrame([(c, n, None, None, None, t, "string", None) for (c, n), t in facts.items()], VALUES)
    contexts = spark.createDataFrame([(r, c) for r in roots for c in range(3)], "rule_id int, context_id long")
    written, keep = [], predicates.materialize

    def counting(df, *names):
        made = keep(df, *names)
        written.append(made.count())
        return made

    monkeypatch.setattr(predicates, "materialize", counting)
    found = {(r.rule_id, r.context_id): r.truth for r in predicates.evaluate_applicability(nodes, values, contexts).collect()}
    assert found == {(r, c): {2: True, 1: None, 0: False}[code(at, c)] for r, at in roots.items() for c in range(3)}
    assert sum(written) == 3 * len(rows)  # each truth once, whatever the depth


def test_forests_without_leaves_or_nodes(spark):
    none = [None] * 12
    nodes = spark.createDataFrame([(1, 1, None, 0, "all", *none), (2, 2, None, 0, "any", *none)], NODES)
    values = spark.createDataFrame([], VALUES)
    contexts = spark.createDataFrame([(1, 7), (2, 7)], "rule_id int, context_id long")
    assert {(r.rule_id, r.truth) for r in predicates.evaluate_applicability(nodes, values, contexts).collect()} == {(1, True), (2, False)}
    assert predicates.evaluate_applicability(nodes.limit(0), values, contexts).count() == 0
