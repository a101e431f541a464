"""Table functions for lateral use in SQL: ``flatten_json`` and ``diff_states``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from assayer.functions.documents import _walk


@udtf(returnType="pointer string, type string, value string, size bigint")
class FlattenJson:
    """``flatten_json(document)``: a row for each value; nothing for a text that is not JSON."""

    def eval(self, document: str):
        try:
            value = json.loads(document)
        except (TypeError, ValueError):
            return
        rows: list = []
        _walk(value, "", rows)
        yield from rows


@udtf(returnType="pointer string, change string")
class DiffStates:
    """``diff_states(before, after)``: added, removed and replaced values by pointer."""

    def eval(self, before: str, after: str):
        try:
            todo = [("", json.loads(before), json.loads(after))]
        except (TypeError, ValueError):
            return
        while todo:
            at, a, b = todo.pop()
            if isinstance(a, dict) and isinstance(b, dict):
                for k in a.keys() | b.keys():
                    below = f"{at}/{k.replace('~', '~0').replace('/', '~1')}"
                    if k not in b:
                        yield below, "removed"
                    elif k not in a:
                        yield below, "added"
                    else:
                        todo.append((below, a[k], b[k]))
            elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
                todo += [(f"{at}/{i}", x, y) for i, (x, y) in enumerate(zip(a, b))]
            elif type(a) is not type(b) or a != b:
                yield at, "replaced"


def register(spark: SparkSession) -> None:
    spark.udtf.register("flatten_json", FlattenJson)
    spark.udtf.register("diff_states", DiffStates)
