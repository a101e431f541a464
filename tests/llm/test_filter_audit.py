"""Filter audits against applying the filters one after another, in every order."""

from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import filter_audit

COUNTS = st.dictionaries(st.integers(0, 31), st.tuples(*[st.integers(0, 9)] * 3), max_size=32)


def plain_report(part, masks):
    """Rows from ``masks``, one ``(mask, good, toxic)`` a document, by applying every order to the documents."""
    out = []
    for order in permutations(range(5)):
        left = list(masks)
        for step, f in enumerate(order, 1):
            hit = [m for m in left if m[0] >> f & 1]
            left = [m for m in left if not m[0] >> f & 1]
            fails = sum(m[0] >> f & 1 for m in masks)
            shapley = 0
            for other in permutations(range(5)):
                before = [g for g in other[: other.index(f)]]
                shapley += sum(m[0] >> f & 1 and not any(m[0] >> g & 1 for g in before) for m in masks)
            out.append((part, "".join("ABCDE"[g] for g in order), step, len(left), len(hit), fails - len(hit), sum(m[0] == 1 << f for m in masks), sum(m[1] for m in hit), sum(m[2] for m in hit), shapley))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(COUNTS)
def test_diagrams_give_what_counting_gives(counts):
    found = {(r[1], r[2]): r for r in filter_audit.report("p", counts)}
    assert len(found) == 600

    def total(k, hit):
        return sum(w[k] for m, w in counts.items() if hit(m))

    shapley = dict.fromkeys(range(5), 0)
    for order in permutations(range(5)):
        for step, f in enumerate(order, 1):
            before = sum(1 << g for g in order[: step - 1])
            row = found["".join("ABCDE"[g] for g in order), step]
            assert row[3] == total(0, lambda m: not m & (before | 1 << f))
            lost = [total(k, lambda m: not m & before and m >> f & 1) for k in range(3)]
            assert [row[4], row[7], row[8]] == lost
            assert row[5] == total(0, lambda m: m >> f & 1) - lost[0] and row[6] == total(0, lambda m: m == 1 << f)
            shapley[f] += lost[0]
    assert all(row[9] == shapley["ABCDE".index(order[step - 1])] for (order, step), row in found.items())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_adjacent_swaps_meet_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for k in filter_audit.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_a_swap_leaves_other_levels_alone():
    diagram = filter_audit.Diagram({0: (3, 1, 0), 5: (2, 2, 1), 31: (1, 0, 1)}, 5)
    below = {n for n, t in enumerate(diagram.tests) if t and t[0] > 1}
    diagram.swap(0)
    assert {n for n, t in enumerate(diagram.tests) if t and t[0] > 1} == below
    diagram.swap(0)
    assert diagram.order == list(range(5)) and list(diagram.steps()) == list(filter_audit.Diagram({0: (3, 1, 0), 5: (2, 2, 1), 31: (1, 0, 1)}, 5).steps())


def masks(rows, labels):
    first, out = {}, {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, source in rows:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        mask = (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) << 2
        mask |= any(c in "#$%&*|" for c in text) << 3 | (i is not None and i > first[text]) << 4
        said = [lab for lab in labels if lab[0] == i and i is not None]
        out.setdefault(source or "", []).append((mask, any(s[1] == 1 for s in said), any(s[2] == 1 for s in said)))
    return out


ROWS = [
    (1, "plain words " * 5, "a"), (2, "plain words " * 5, "a"), (3, "plain words " * 5, None), (2, "plain words " * 5, "a"), (4, None, "a"), (5, "", "b"),
    (None, "", "b"), (None, "plain words " * 5, ""), (6, " ".join(f"w{i}" for i in range(60)), "a"), (7, "ABC é日本 #", "b"), (8, "a | b", "b"),
    (9, " ".join(f"w{i}" for i in range(60)), "c"), (10, "word " * 20000 + "Tail", "c"), (11, "A" + "b" * 19, "c"), (12, "A" + "é" * 18, "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (99, 1, 1), (None, 1, 1), (9, None, 0), (7, 0, 1)]


def test_equals_plain_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "'x' AS part", "1 AS mask", "2 AS n", "3 AS good")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = sorted(row for part, found in masks(ROWS, LABELS).items() for row in plain_report(part, found))
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in filter_audit.audit(docs, labels.filter("false")).collect()} == {(0, 0)}
