"""JSON documents: canonical form and identity, flattening, typed differences, schema checks."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.storage import materialize

SAFE_INTEGER = 2**53 - 1
STRINGS = r'"(?:[^"\\]|\\.)*"'


def nfc_check():
    """Whether texts are in Unicode normal form C."""

    def check(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.is_normalized("NFC", t)).astype("boolean")

    return F.pandas_udf(check, "boolean")


def _is_nfc(text: Column) -> Column:
    """Only texts beyond ASCII reach Python."""
    beyond = F.octet_length(text) != F.char_length(text)
    return F.coalesce(nfc_check()(F.when(beyond, text)), F.lit(True))


def json_problem(text: Column) -> Column:
    """Why a text has no canonical form: not JSON (or a repeated key), a number with fraction or exponent, an
    integer beyond 2^53, or text not in normal form C."""
    bare = F.regexp_replace(text, STRINGS, '""')
    numbers = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+"), F.lit(0))
    large = F.exists(numbers, lambda n: F.coalesce(F.abs(n.try_cast("decimal(38,0)")) > SAFE_INTEGER, F.lit(True)))
    return (
        F.when(F.try_parse_json(text).isNull(), "not_json").when(bare.rlike(r"[0-9]\.[0-9]|[0-9][eE]"), "not_an_integer").when(large, "integer_range").when(~_is_nfc(text), "not_nfc")
    )


def canonical_json(text: Column) -> Column:
    """Keys sorted, no white space; null where :func:`json_problem` has something to say."""
    return F.when(json_problem(text).isNull(), F.to_json(F.try_parse_json(text)))


def content_identity(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def canonicalize_documents(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    out = df.withColumn("json_problem", json_problem(c))
    out = out.withColumn("canonical", F.when(F.col("json_problem").isNull(), F.to_json(F.try_parse_json(c))))
    return out.withColumn("identity", content_identity(F.col("canonical")))


def _walk(value, pointer: str, out: list) -> None:
    todo = [(pointer, value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            out.append((at, "object", None, len(v)))
            todo += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
        elif isinstance(v, list):
            out.append((at, "array", None, len(v)))
            todo += [(f"{at}/{i}", x) for i, x in enumerate(v)]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
            out.append((at, kind, v if isinstance(v, str) else json.dumps(v), None))


def flatten_documents(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, pointer, type, value, size``: a row for each value of each document, containers with their size.

    Texts that are not JSON give no row.
    """
    kind = dict(df.dtypes)[key]

    def flatten(batches):
        for pdf in batches:
            keys, rows = [], []
            for k, text in zip(pdf[key], pdf[column]):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                n = len(rows)
                _walk(value, "", rows)
                keys += [k] * (len(rows) - n)
            out = pd.DataFrame(rows, columns=["pointer", "type", "value", "size"])
            out.insert(0, key, keys)
            out["size"] = out["size"].astype("Int64")
            yield out

    return df.select(key, F.col(column).cast("string").alias(column)).mapInPandas(flatten, f"{key} {kind}, pointer string, type string, value string, size long")


def diff_documents(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """``key, pointer, change``: added, removed or replaced; what lies below a change is part of it.

    Objects are compared by key; arrays of one length by place, arrays of two lengths are one replacement.
    """
    side = lambda df, p: flatten_documents(df, key, column).select(key, "pointer", *[F.col(c).alias(f"{p}_{c}") for c in ("type", "value", "size")])
    both = side(before, "old").join(side(after, "new"), [key, "pointer"], "full_outer")
    array = F.col("old_type") == "array"
    same = (F.col("old_type") == F.col("new_type")) & F.when(array, F.col("old_size") == F.col("new_size")).when(F.col("old_type") == "object", True).otherwise(F.col("old_value").eqNullSafe(F.col("new_value")))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(~same, "replaced")
    changed = both.select(key, "pointer", change.alias("change")).filter("change is not null")
    parts = F.split("pointer", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = changed.filter("pointer <> ''").select(key, "pointer", F.explode(above).alias("above"))
    hidden = inner.join(changed.select(key, F.col("pointer").alias("above")), [key, "above"]).select(key, "pointer").distinct()
    return changed.join(hidden, [key, "pointer"], "left_anti")


def pattern_of(pointer: Column) -> Column:
    """A pointer with places in arrays as stars."""
    return F.regexp_replace(pointer, r"/[0-9]+(?=/|$)", "/*")


def _above(pointer: Column, own: bool) -> Column:
    """The pointers of the values that hold a value, the root first, with its own at the end if asked for."""
    parts = F.split(pointer, "/", -1)
    upto = F.size(parts) if own else F.size(parts) - 1
    return F.when(upto > 0, F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def _not_below(found: DataFrame, stopped: DataFrame, key: str, at: str, own: bool) -> DataFrame:
    """``found`` without rows whose pointer ``at`` lies below (or, if asked for, at) a pointer of ``stopped``."""
    inner = found.select(key, at).distinct().select(key, at, F.explode(_above(F.col(at), own)).alias("__above"))
    hidden = inner.join(stopped.select(key, F.col("pointer").alias("__above")), [key, "__above"], "left_semi").select(key, at).distinct()
    return found.join(hidden, [key, at], "left_anti")


def _in_branch(rows: DataFrame, chosen: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` whose ``branches`` are all among those that their document has chosen above, or at, the pointer ``at``."""
    none = F.coalesce(F.size("branches"), F.lit(0)) == 0
    wanted = rows.filter(~none).select(key, F.col(at).alias("__at"), "rule", F.size(F.array_distinct("branches")).alias("__n"), F.explode(F.array_distinct("branches")).alias("__b"))
    wanted = wanted.select(key, "__at", "rule", "__n", "__b.union", "__b.option")
    depth = F.size(F.split("union", "/", -1))
    met = wanted.withColumn("pointer", F.array_join(F.slice(F.split("__at", "/", -1), F.lit(1), depth), "/")).join(chosen, [key, "pointer", "union", "option"], "left_semi")
    whole = met.groupBy(key, "__at", "rule", "__n").agg(F.count(F.lit(1)).alias("__met")).filter("__met = __n").select(key, F.col("__at").alias(at), "rule")
    return rows.filter(none).unionByName(rows.filter(~none).join(whole, [key, at, "rule"], "left_semi").select(*rows.columns))


BRANCHES = "array<struct<union: string, option: string>>"
UNIONS = "at string, tag string, value string, option string"


def validate_against_schema(documents: DataFrame, schema: DataFrame, key: str, column: str, unions: DataFrame | None = None) -> DataFrame:
    """``key, pointer, problem``: value not listed, wrong type, text not matching, unknown property, required property missing.

    ``schema(pattern, types, required, members, matching)`` has a row for each pointer pattern.  What lies
    below a value of the wrong type, an unlisted one or an unknown property is not looked at, and a value has
    one problem at most.

    ``unions(at, tag, value, option)`` are tagged unions: at pattern ``at`` the property ``tag`` chooses an option by
    its value, and several values may choose the same.  A schema row with ``branches``, an array of ``(union, option)``,
    holds only where each union that it names has that option; patterns of nested unions name the outer one
    too.  Where the tag is missing or its value chooses nothing, that is the only problem of the union, and nothing
    below it is looked at; a property of another option's is unknown.  Where several rows hold for a pointer, the first in
    order of their contents counts.
    """
    spark = documents.sparkSession
    if "branches" not in schema.columns:
        schema = schema.withColumn("branches", F.lit(None).cast(BRANCHES))
    unions = unions if unions is not None else spark.createDataFrame([], UNIONS)
    rules = schema.select("pattern", "types", "required", "members", "matching", "branches")
    rules = rules.withColumn("rule", F.to_json(F.struct("pattern", "branches", "types", "required", "members", "matching")))
    rows = materialize(flatten_documents(documents, key, column).withColumn("pattern", pattern_of(F.col("pointer"))), "flattened")

    places = rows.join(unions.select(F.col("at").alias("pattern"), "tag").distinct(), "pattern").select(key, "pointer", F.col("pattern").alias("union"), "type", "tag")
    places = places.withColumn("tag_pointer", F.concat("pointer", F.lit("/"), F.replace(F.replace("tag", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    tags = rows.select(key, F.col("pointer").alias("tag_pointer"), "value", F.lit(True).alias("there"))
    options = unions.select(F.col("at").alias("union"), "tag", "value", "option").distinct()
    places = materialize(places.join(tags, [key, "tag_pointer"], "left").join(options, ["union", "tag", "value"], "left"), "unions")
    chosen = places.filter("option is not null and type = 'object'").select(key, "pointer", "union", "option")

    held = _in_branch(rows.select(key, "pointer", "pattern").join(rules, "pattern"), chosen, key, "pointer")
    held = held.groupBy(key, "pointer").agg(F.min_by(F.struct("types", "members", "matching"), "rule").alias("r"))
    found = rows.join(held, [key, "pointer"], "left")
    own = F.when(F.col("r").isNull(), "unknown_property").when(F.col("r.members").isNotNull() & ~F.coalesce(F.array_contains("r.members", F.col("value")), F.lit(False)), "not_listed")
    own = own.when(~F.array_contains("r.types", F.col("type")), "wrong_type").when(~F.call_function("rlike", F.col("value"), F.col("r.matching")), "no_match")
    broken = materialize(found.select(key, "pointer", own.alias("problem")).filter("problem is not null"), "broken")

    # No value of a union with an open tag is looked at.
    unsettled = places.filter("type <> 'object' or option is null")
    problem = F.when(F.col("type") != "object", "wrong_type").when(F.col("there").isNull(), "required_missing").otherwise("not_listed")
    at_tag = F.when(F.col("type") == "object", F.col("tag_pointer")).otherwise(F.col("pointer"))
    stopped = broken.filter("problem <> 'no_match'").select(key, "pointer")
    open_tags = _not_below(unsettled.select(key, "pointer", at_tag.alias("said_at"), problem.alias("problem")), stopped, key, "pointer", own=True)
    stopped = stopped.unionByName(unsettled.select(key, "pointer")).distinct()
    open_tags = _not_below(open_tags, stopped, key, "pointer", own=False).select(key, F.col("said_at").alias("pointer"), "problem")

    wanted = rules.filter("required and pattern <> ''").select(F.regexp_replace("pattern", "/[^/]*$", "").alias("above"), F.regexp_extract("pattern", "/([^/]*)$", 1).alias("name"), "branches", "rule")
    parents = rows.filter("type = 'object'").select(key, F.col("pointer").alias("parent"), F.col("pattern").alias("above"))
    due = _in_branch(parents.join(wanted, "above"), chosen, key, "parent").select(key, "parent", F.concat("parent", F.lit("/"), "name").alias("pointer")).distinct()
    lost = _not_below(due.join(rows.select(key, "pointer"), [key, "pointer"], "left_anti"), stopped, key, "parent", own=True)
    lost = lost.select(key, "pointer", F.lit("required_missing").alias("problem"))
    return _not_below(broken, stopped, key, "pointer", own=False).select(key, "pointer", "problem").unionByName(open_tags).unionByName(lost)


def invocation_identity(capability: Column, parameters: Column, inputs: Column, environment: Column, required_environment: Column) -> Column:
    """Digest of what makes an invocation: maps and arrays are put in order, program name and outcome stay out.

    Of required environment variables only the names count.
    """
    ordered = lambda m: F.array_sort(F.map_entries(m))
    whole = F.struct(capability.alias("capability"), ordered(parameters).alias("parameters"), F.array_sort(inputs).alias("inputs"), ordered(environment).alias("environment"), F.array_sort(F.map_keys(required_environment)).alias("required_environment"))
    return content_identity(F.to_json(whole))
