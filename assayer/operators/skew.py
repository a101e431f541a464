"""Joins with counted keys, of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, so there are fewer hot keys than its inverse.
HOT_PART = 1e-4


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has each key once and says how many rows hold it.

    Hot keys are fewer than 1 / HOT_PART whatever the data, so they are broadcast and their rows stay where
    they are; all other rows are shuffled by key, in groups of at most HOT_PART of ``total``.
    """
    key = [key] if isinstance(key, str) else key
    most = max(1.0, total * HOT_PART)
    hot = F.broadcast(counted.filter(F.col(count) > F.lit(most)))
    usual = rows.join(hot.select(*key), key, "left_anti").join(counted.filter(F.col(count) <= F.lit(most)), key)
    return rows.join(hot, key).unionByName(usual)
