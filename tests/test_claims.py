"""Claim fields are found by JSON pointers that are rows of a table."""

import json

from pyspark.sql import functions as F

from assayer.sources import files


def follow(document, pointer):
    for name in pointer.split("/")[1:]:
        name = name.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list) and name.isdigit() and (name == "0" or name[0] != "0") and int(name) < len(document):
            document = document[int(name)]
        elif isinstance(document, dict) and name in document:
            document = document[name]
        else:
            return None
    return document


def test_pointers_lead_where_plain_python_goes(spark):
    document = {
        "a": {"b c": ["x", {"1": "one", "01": "o", "": "empty"}], "~/": "tilde", "q?": "ask", "it's": "single", 'say "so"': "double", "'\"": "both", "[0]": "square", "\\": "back", "é": "accent"},
        "0": "zero", "list": [["p", "q"], []], "none": None,
    }
    escape = lambda n: n.replace("~", "~0").replace("/", "~1")
    pointers = [f"/a/{escape(n)}" for n in document["a"]] + ["/a/b c/0", "/a/b c/1/1", "/a/b c/1/01", "/a/b c/1/", "/0", "/1", "/list/0/1", "/list/0/2", "/list/00/1", "/list/1/0", "/list/-", "/none", "/none/x", "/a/b c/0/x", "/lost", "/a.0", "/list/99999999999"]
    df = spark.createDataFrame([(p, json.dumps(document)) for p in pointers], "p string, d string")
    found = {r.p: r.v for r in df.select("p", files.at_pointer(F.try_parse_json("d"), F.col("p")).alias("v")).collect()}
    for p in pointers:
        want = follow(document, p)
        assert json.loads(found[p]) == want if isinstance(want, (dict, list)) else found[p] == want, p
    odd = spark.createDataFrame([(None, "{}"), ("/a", None), ("/a", "not json"), ("", '"whole"')], "p string, d string")
    assert [r.v for r in odd.select(files.at_pointer(F.try_parse_json("d"), F.col("p")).alias("v")).collect()] == [None, None, None, "whole"]


def test_any_number_of_pointers(spark):
    """Three thousand descriptors with a pointer each: one plan, and no problem but those that there are."""
    n = 3000
    descriptors = spark.range(n).selectExpr("cast(id as string) descriptor_id", "'exact' model", "cast(null as string) lower_at", "cast(null as string) upper_at", "concat('/k', id, '/', id % 3) nominal_at", "cast(null as string) value_at", "id % 5 = 0 optional")
    outputs = spark.range(n).selectExpr("id output_id", "cast(id as string) descriptor_id", "concat('{\"k', id, '\":[\"', id, '\",\"', id + 1, '\"]}') document")
    claims = files.extract_claims(outputs, descriptors)
    few = files.extract_claims(outputs, descriptors.limit(3))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(claims) < 1.2 * size(few)
    for r in claims.collect():
        place = r.output_id % 3
        assert r.nominal == (str(r.output_id + place) if place < 2 else None)
        assert r.problem == ("absent:nominal" if place == 2 and r.output_id % 5 else None)
