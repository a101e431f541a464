"""Tagged unions in document schemas, against a plain recursive checker."""

import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assayer.functions import documents

# A node: type, and for objects either properties (schema, required) or a union (tag, {value: option}, {option: node}).
CARD = {"type": "object", "properties": {"type": ({"type": "string"}, True), "n": ({"type": "integer"}, True)}}
CASH = {"type": "object", "properties": {"type": ({"type": "string"}, True), "inner": ({"union": ("t", {"p": "P", "q": "P"}, {"P": {"type": "object", "properties": {"t": ({"type": "string"}, True), "z": ({"type": "string", "members": ["u", "v"]}, False)}}})}, False)}}
PAY = {"union": ("type", {"card": "card", "cash": "cash"}, {"card": CARD, "cash": CASH})}
ROOT = {"type": "object", "properties": {"pays": ({"type": "array", "items": PAY}, True), "name": ({"type": "string", "matching": "^[a-z]+$"}, False)}}


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def text(v):
    return v if isinstance(v, str) else None if isinstance(v, (list, dict)) else json.dumps(v)


def check(node, v, at, out):
    if "union" in node:
        tag, values, options = node["union"]
        if not isinstance(v, dict):
            out.add((at, "wrong_type"))
        elif tag not in v:
            out.add((f"{at}/{tag}", "required_missing"))
        elif text(v[tag]) not in values:
            out.add((f"{at}/{tag}", "not_listed"))
        else:
            check(options[values[text(v[tag])]], v, at, out)
        return
    if "members" in node and text(v) not in node["members"]:
        out.add((at, "not_listed"))
    elif kind(v) != node["type"]:
        out.add((at, "wrong_type"))
    elif isinstance(v, str) and not re.search(node.get("matching", ""), v):
        out.add((at, "no_match"))
    elif isinstance(v, list):
        for i, x in enumerate(v):
            check(node["items"], x, f"{at}/{i}", out)
    elif isinstance(v, dict):
        for name, (_, required) in node["properties"].items():
            if required and name not in v:
                out.add((f"{at}/{name}", "required_missing"))
        for name, x in v.items():
            if name in node["properties"]:
                check(node["properties"][name][0], x, f"{at}/{name}", out)
            else:
                out.add((f"{at}/{name}", "unknown_property"))


def rules(node, at, required, branches, rows, unions):
    if "union" in node:
        tag, values, options = node["union"]
        rows.append((at, ["object"], required, None, None, branches))
        unions += [(at, tag, value, option) for value, option in values.items()]
        for option, inner in options.items():
            below = [*branches, (at, option)]
            for name, (x, must) in inner["properties"].items():
                rules(x, f"{at}/{name}", must, below, rows, unions)
        return
    rows.append((at, [node["type"]], required, node.get("members"), node.get("matching"), branches))
    if "items" in node:
        rules(node["items"], f"{at}/*", False, branches, rows, unions)
    for name, (x, must) in node.get("properties", {}).items():
        rules(x, f"{at}/{name}", must, branches, rows, unions)


SCALARS = st.sampled_from(["card", "cash", "p", "q", "u", "w", "Name", 1, 2, True, None])
INNER = st.one_of(SCALARS, st.dictionaries(st.sampled_from(["t", "z", "type", "n"]), SCALARS, max_size=3), st.fixed_dictionaries({"t": st.sampled_from(["p", "q"])}, optional={"z": SCALARS, "n": SCALARS}))
PAYMENT = st.one_of(SCALARS, st.fixed_dictionaries({}, optional={"type": st.sampled_from(["card", "cash", "x", 1]), "n": SCALARS, "inner": INNER, "extra": INNER}))
DOCUMENT = st.one_of(SCALARS, st.fixed_dictionaries({}, optional={"pays": st.one_of(SCALARS, st.lists(PAYMENT, max_size=3)), "name": SCALARS, "odd": INNER}))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(DOCUMENT, min_size=300, max_size=300))
def test_equals_a_plain_checker(spark, docs):
    rows, unions = [], []
    rules(ROOT, "", False, [], rows, unions)
    schema = spark.createDataFrame(rows, f"pattern string, types array<string>, required boolean, members array<string>, matching string, branches {documents.BRANCHES}")
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id long, doc string")
    got = sorted(map(tuple, documents.validate_against_schema(table, schema, "id", "doc", spark.createDataFrame(unions, documents.UNIONS)).collect()))
    want = []
    for i, d in enumerate(docs):
        out = set()
        check(ROOT, d, "", out)
        want += [(i, *x) for x in out]
    assert got == sorted(want)
