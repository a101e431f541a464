"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  Along the source, in an order that
runs from long to short documents, expected copies are summed up, one random offset of the source is added,
and a document is emitted once per integer boundary that its share crosses.  So the words taken differ
from the target by less than the longest document, for any number of rows.  The offset is a hash of the
seed and the source.

Places along a source come from range partitions of all rows, numbered inside each, so neither a hot
source nor many sources are one task's work.  Targets come from sums over ranges of the breakpoints at
which sources reach their cap, narrowed down to one breakpoint in a fixed number of passes.

Defined cases: a null text has size 0 and null is a source of its own, last in order; documents of
size 0 may be emitted but take no words; a source without words gets target 0; rows are mixed each,
also when repeated; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.ordered import number_rows
from assayer.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges that breakpoints are summed over in a pass of the search for the common rate.
RANGES = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def common_rate(weighed: DataFrame, budget: float) -> float:
    """The rate r at which the sum of ``least(most, weight * r)`` over ``weighed(weight, most)`` is ``budget``.

    A source is capped from its breakpoint ``most / weight`` on.  The interval that holds r is cut into RANGES
    ranges at a time, and one aggregate gives each its sums, until no breakpoint lies inside it.
    """
    at = F.col("most") / F.col("weight")
    whole, high = weighed.agg(F.sum("most"), F.max(at)).first()
    if not whole or budget >= whole:
        return high or 0.0
    low = capped = 0.0  # breakpoints up to ``low`` are capped, those from ``high`` on are free
    free = weighed.filter(at > high).agg(F.sum("weight")).first()[0] or 0.0
    while True:
        step = (high - low) / RANGES
        place = F.least(F.floor((at - low) / step), F.lit(RANGES - 1)).cast("int")
        inside = weighed.filter((at > low) & (at <= high)).groupBy(place.alias("place")).agg(
            F.min(at).alias("first"), F.max(at).alias("last"), F.sum("most").alias("most"), F.sum("weight").alias("weight")
        )
        ranges = sorted(inside.collect())  # RANGES rows at most
        left = sum(r.weight for r in ranges) + free
        for r in ranges:
            # At the rate ``last`` of this range, its sources are capped and those behind it are free.
            if capped + r.most + (left - r.weight) * r["last"] >= budget:
                break
            capped, left, low = capped + r.most, left - r.weight, r["last"]
        else:
            return (budget - capped) / free
        if capped + left * r.first >= budget:  # reached before the range's first breakpoint
            return (budget - capped) / left
        if r.first == r["last"]:
            return r.first
        free, low, high = left - r.weight, math.nextafter(r.first, 0.0), r["last"]


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sources(key, source, source_size)`` with ``target``: ``share`` of all words by weight, capped.

    Weights repeat along the sources in code-point order, null last.  What capped sources leave is
    shared among the others by weight: all others grow at one common rate.
    """
    ranked = number_rows(sources, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(ranked.select("key", "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate = common_rate(weighed.filter("most > 0"), share * total)
    return weighed.select("key", "source", "source_size", F.least("most", F.col("weight") * F.lit(rate)).alias("target"))


def crossed(rank: Column, copies: Column, offset: Column) -> Column:
    """Integer boundaries between the expected copies before ``rank`` (from 0) and up to it."""
    passed = F.floor((rank + 1) * copies + offset) - F.floor(rank * copies + offset)
    return F.least(passed, F.ceil(copies))


def offset(key: Column, seed: int) -> Column:
    """A source's random offset in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) / float(1 << 20)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``id, source, size, source_size, target, rank, copies, taken`` for every row; ``rank`` is its place in its source."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = materialize(picked.withColumns({"key": key, "row": F.monotonically_increasing_id()}), "mix-rows")
    sources = rows.groupBy("key").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    plan = targets(sources, weights, share, cap).drop("source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rows alike in source, size and id are told apart by place, which of them comes first makes no difference.
    ranked = number_rows(rows, [F.desc("size"), F.col("id"), F.col("row")], by=["key"])
    mixed = ranked.join(plan.withColumn("expected", expected), "key")
    copies = crossed(F.col("rank"), F.col("expected"), offset(F.col("key"), seed))
    return mixed.select("id", "source", "size", "source_size", "target", "rank", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` repeated as the mix says, with all their columns.

    Rows alike in id, source and size are alike to the mix too, and are told apart by their place among these.
    """
    alike = ["__no_id", "__id", "__no_source", "__source", "__size"]

    def keys(id_: Column, source: Column, size: Column) -> dict[str, Column]:
        # Without nulls, so that joins and numberings deal rows alike.
        return {
            "__no_id": id_.isNull(), "__id": F.coalesce(id_.cast("string"), F.lit("")),
            "__no_source": source.isNull(), "__source": F.coalesce(source.cast("string"), F.lit("")), "__size": size,
        }

    nth = F.row_number().over(Window.partitionBy(*alike).orderBy(*alike))
    keyed = docs.withColumns(keys(F.col(id_col), F.col(source_col), word_count(F.col(text_col)))).withColumn("__nth", nth)
    given = mixed.select("id", "source", "size", F.col("copies").alias("__copies")).withColumns(keys(F.col("id"), F.col("source"), F.col("size")))
    given = given.withColumn("__nth", nth).select(*alike, "__nth", "__copies").filter("__copies > 0")
    repeated = keyed.join(given, [*alike, "__nth"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
