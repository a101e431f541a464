"""Strong components against a plain double reach, over random and adverse graphs."""

import numpy as np
import pytest

from assayer.operators import graph


def plain(edges):
    nodes = {x for e in edges for x in e}
    onward = {n: {b for a, b in edges if a == n} for n in nodes}

    def reached(start):
        seen, todo = set(), list(onward[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += onward[n]
        return seen

    far = {n: reached(n) for n in nodes}
    return {(n, min([n, *(m for m in far[n] if n in far[m])]), n in far[n]) for n in nodes}


def ours(spark, edges, kind="long"):
    return {tuple(r) for r in graph.detect_cycles(spark.createDataFrame(edges, f"src {kind}, dst {kind}")).select("node", "component", "on_cycle").collect()}


GRAPHS = {
    "below a cycle": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (0, 1)],
    "between two cycles": [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)],
    "loops": [(1, 1), (1, 2), (2, 3), (3, 3)],
    "no cycle": [(1, 2), (2, 3), (1, 3)],
    "repeated": [(1, 2), (1, 2), (2, 1), (2, 1)],
    "one ring": [(i, (i + 1) % 12) for i in range(12)],
    "nested rings": [(i, (i + 1) % 8) for i in range(8)] + [(3, 20), (20, 21), (21, 3), (9, 3), (5, 9)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    assert ours(spark, GRAPHS[name]) == plain(GRAPHS[name])


@pytest.mark.parametrize("seed", [0, 1])
def test_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 25, (30, 2))]
    assert ours(spark, edges) == plain(edges)


def test_text_nodes_nulls_and_no_edges(spark):
    assert ours(spark, [("a", "b"), ("b", "a"), ("b", "c"), (None, "a"), ("c", None)], "string") == {("a", "a", True), ("b", "a", True), ("c", "c", False)}
    assert ours(spark, []) == set()
