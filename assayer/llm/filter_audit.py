"""How filters overlap: what each removes in every order they may be applied in.

Five filters read each whole text; a document's failures are a mask of five bits.  Spark reduces the
documents to counts a part, mask and label, so a part is at most 128 rows whatever its documents.  From
these a count-weighted decision diagram is built for each part: a level tests one filter, and a node
weighs what its leaves count.  All orders are reached by swapping adjacent levels, each swap rebuilding
two levels only, and in each order the path on which all filters pass gives what every step keeps and
removes.

Whether a text was seen before is decided without joining rows back to their group: rows are combined by
digest, part, labels and id before anything else, so a text that holds a third of all rows is a few rows
a task by the time it meets its copies.

Defined cases: a null text is empty; parts are sources, null being the part ''; an empty text has 0 words,
so it fails the least length and, where an earlier one exists, the repetition filter only; a row without
id is never earlier than another and has no earlier one, and neither have rows of one id and text among
themselves; a document counts as good (toxic) if any of its labels says so; repeated rows count each; an
empty table has no parts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
Weight = tuple[int, int, int]

REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    failures = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    found = F.lit(0)
    for bit, failed in enumerate(failures):
        found = found + F.when(failed, 1 << bit).otherwise(0)
    return found.cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by failure mask, all of them and the labelled ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"),
    )
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    alike = ["digest", "part", "mask", "good", "toxic"]
    rows = read.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(known, "id", "left").na.fill(False, ["good", "toxic"])
    # Rows of the least id of a set of alike rows have not failed, if no other set of the digest has a lesser id.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    sets = rows.groupBy(*alike).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    fresh = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    told = sets.withColumn("first", first).withColumn("fresh", fresh)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << REPEATED)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )
    counted = told.select("part", "good", "toxic", F.explode(both).alias("m")).select("part", "good", "toxic", "m.mask", "m.n")
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


class Diagram:
    """A decision diagram over failure masks whose nodes weigh what lies below them.

    Nodes are numbers; equal nodes are one.  ``tests[node]`` is ``(filter, node if it passes, node if it
    fails)``, none at leaves; ``weights[node]`` is the sum over the leaves that its paths reach.
    """

    def __init__(self, counts: dict[int, Weight], filters: int):
        self.order = list(range(filters))
        self.tests: list[tuple[int, int, int] | None] = []
        self.weights: list[Weight] = []
        self._known: dict[tuple, int] = {}
        self.root = self._build(counts, 0, 0)

    def _node(self, key: tuple, test: tuple[int, int, int] | None, weight: Weight) -> int:
        if key not in self._known:
            self._known[key] = len(self.tests)
            self.tests.append(test)
            self.weights.append(weight)
        return self._known[key]

    def _test(self, which: int, passed: int, failed: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed]))
        return self._node((which, passed, failed), (which, passed, failed), weight)

    def _build(self, counts: dict[int, Weight], depth: int, mask: int) -> int:
        if depth == len(self.order):
            weight = counts.get(mask, (0, 0, 0))
            return self._node(("leaf", weight), None, weight)
        which = self.order[depth]
        return self._test(which, self._build(counts, depth + 1, mask), self._build(counts, depth + 1, mask | 1 << which))

    def swap(self, depth: int) -> None:
        """Exchange the filters of levels ``depth`` and ``depth + 1``; levels below stay as they are."""
        upper, lower = self.order[depth], self.order[depth + 1]
        done: dict[int, int] = {}

        def turned(node: int, level: int) -> int:
            if node not in done:
                which, passed, failed = self.tests[node]
                if level < depth:
                    done[node] = self._test(which, turned(passed, level + 1), turned(failed, level + 1))
                else:
                    (_, pp, pf), (_, fp, ff) = self.tests[passed], self.tests[failed]
                    done[node] = self._test(lower, self._test(upper, pp, fp), self._test(upper, pf, ff))
            return done[node]

        self.root = turned(self.root, 0)
        self.order[depth], self.order[depth + 1] = lower, upper

    def steps(self) -> Iterator[tuple[int, Weight, Weight, Weight]]:
        """``(filter, kept, removed, failing it alone)`` along the path on which every filter passes."""
        node = self.root
        for _ in self.order:
            which, passed, failed = self.tests[node]
            alone = failed
            while self.tests[alone] is not None:
                alone = self.tests[alone][1]
            yield which, self.weights[passed], self.weights[failed], self.weights[alone]
            node = passed


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places ``k`` to swap with ``k + 1`` so that ``n`` things run through all their orders, each once."""
    if n < 2:
        return
    down, inner = True, adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the thing that travelled stands in front, or behind
        down = not down


def report(part: str, counts: dict[int, Weight], filters: str = FILTERS) -> list[tuple]:
    """Rows of :data:`REPORT` for one part."""
    diagram, found = Diagram(counts, len(filters)), {}
    found["".join(filters[w] for w in diagram.order)] = list(diagram.steps())
    for place in adjacent_swaps(len(filters)):
        diagram.swap(place)
        found["".join(filters[w] for w in diagram.order)] = list(diagram.steps())
    # A filter's failures are what it removes where it comes first.
    fails = {steps[0][0]: steps[0][2][0] for steps in found.values()}
    shapley = dict.fromkeys(fails, 0)
    for steps in found.values():
        for which, _, removed, _ in steps:
            shapley[which] += removed[0]
    return [
        (part, order, at, kept[0], removed[0], fails[which] - removed[0], alone[0], removed[1], removed[2], shapley[which])
        for order, steps in sorted(found.items())
        for at, (which, kept, removed, alone) in enumerate(steps, 1)
    ]


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The rows of :data:`REPORT` for each part, order of the five filters, and step."""
    names = [c.split()[0] for c in REPORT.split(", ")]

    def one_part(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(pdf["mask"], pdf["n"], pdf["good"], pdf["toxic"])}
        return pd.DataFrame(report(pdf["part"].iloc[0], counts), columns=names)

    return mask_counts(docs, labels, **columns).groupBy("part").applyInPandas(one_part, REPORT)
