import numpy as np
import pytest

from assayer.llm import embedding_dedup


def brute(rows, cosine):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    seen, out = {}, []
    for i in range(len(rows)):
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen[i] = min(rows[j][0] for j in group)
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(links[i]), seen[i], vec_id == seen[i]))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_all_pairs(spark, small, monkeypatch):
    if small:
        for name, value in (("PER_PIVOT", 20), ("BLOCK", 8), ("RUN", 5)):
            monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    rows = [(i, (base[i % 60] + rng.normal(size=6) * 0.12).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)] + [(2000, [-x for x in rows[3][1]]), (2001, [2 * x for x in rows[3][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3004, [float("nan")] * 6), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf")] + [0.0] * 5), (3008, [1e30] + [0.0] * 5), (3009, [3e-30] + [0.0] * 4 + [-0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as many")
    got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.95).collect())
    assert got == brute(rows, 0.95)


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_ids_are_vectors_too(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [2.0, 4.0]), (7, [-1.0, 0.0]), (None, [0.0, -1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.95).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (7, 0, 7, True), (None, 0, None, True), (None, 0, None, True)], key=repr)
