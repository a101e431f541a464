import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing

from .conftest import TEXTS


def shares(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        left = budget - sum(target.values())
        each = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / each >= cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / each for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over
        if not free:
            return target


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts, spark):
    """Every row's copies recomputed one by one along its source, and the sums near the targets."""
    sizes, along = defaultdict(int), defaultdict(list)
    for source, text in texts:
        sizes[source] += word_count(text)
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        along[r.source].append(r)
    names = spark.createDataFrame([(s, "n" if s is None else f"s{s}") for s in sizes], "source string, key string") if sizes else None
    offsets = {r.source: r.at for r in names.select("source", mixing.offset(F.col("key"), 17).alias("at")).collect()} if sizes else {}
    assert set(along) == set(sizes)
    for source, found in along.items():
        order = sorted(found, key=lambda r: (-r.size, r.id is not None, r.id or 0))
        assert [(r.size, r.id) for r in sorted(found, key=lambda r: r.rank)] == [(r.size, r.id) for r in order]
        assert sorted(r.rank for r in found) == list(range(len(found)))
        rate, total = want[source] / sizes[source] if sizes[source] else 0.0, 0.0
        for place, r in enumerate(sorted(found, key=lambda r: r.rank)):
            edges = [(place + k) * rate + offsets[source] for k in (0, 1)]
            if all(abs(e - round(e)) > 1e-9 for e in edges):  # else rounding may put the boundary on either side
                assert r.copies == math.floor(edges[1]) - math.floor(edges[0])
            total += r.taken
        assert abs(total - want[source]) <= max(r.size for r in found)


def test_odd_rows(spark, odd_docs, no_docs):
    check(mixing.mix(odd_docs).collect(), [(r[3], r[1]) for r in TEXTS], spark)
    assert mixing.mix(no_docs).count() == 0
    assert mixing.emit(no_docs, mixing.mix(no_docs)).count() == 0


def test_mix_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows, [(r.source, r.text) for r in docs.collect()], spark)
    again = {(r.id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.id, r.copies) for r in rows}


def test_one_hot_source_and_very_many_others(spark):
    rows = [(i, "w " * (1 + i % 7), "hot") for i in range(1500)] + [(5000 + i, "x " * (1 + i % 50), f"s{i:04}") for i in range(1000)] + [(9000 + i, "y", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(df.repartition(7)).collect(), [(r[2], r[1]) for r in rows], spark)


@pytest.mark.parametrize("crowded", [False, True])
@pytest.mark.parametrize("budget", [0.0, 1.0, 10.0, 55.0, 100.0, 149.9, 150.0, 1e9])
def test_common_rate_spends_the_budget(spark, budget, crowded):
    """Breakpoints spread out, or almost all alike."""
    pairs = [(1.0 + i % 3, (1 + i % 3) * (2 + 1e-9 * i) if crowded else 0.5 * (i % 20) + 0.1) for i in range(40)]
    rate = mixing.common_rate(spark.createDataFrame(pairs, "weight double, most double"), budget)
    spent = sum(min(most, weight * rate) for weight, most in pairs)
    assert abs(spent - min(budget, sum(most for _, most in pairs))) < 1e-6


def test_emit_repeats_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs)
    out = mixing.emit(docs, mixed)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.id: r.copies for r in mixed.collect() if r.copies})


def test_emit_odd_rows(odd_docs):
    """Null ids, null sources, repeated rows and clashing columns: each kind of row as often as the mix takes it."""
    mixed = mixing.mix(odd_docs)
    out = mixing.emit(odd_docs, mixed)
    assert out.columns == odd_docs.columns
    want = Counter()
    for r in mixed.collect():
        want[r.id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, word_count(r.text)) for r in out.collect()) == +want
