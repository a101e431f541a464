import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import ngram_model, quality, words


def test_features_of_a_column_are_those_of_single_texts():
    texts = ["Ab ab!! x", "", None, "x x x", "don't", "é é,"]
    single = []
    for t in texts:
        (_, data, offsets), = words.slices(pa.array([t], pa.string()))
        single.append(ngram_model.features(data, offsets, 18)[0].tolist())
    (_, data, offsets), = words.slices(pa.array(texts, pa.string()))
    found, starts = ngram_model.features(data, offsets, 18)
    assert [found[a:b].tolist() for a, b in zip(starts, starts[1:])] == single
    assert [len(s) for s in single] == [7, 0, 0, 5, 5, 5]


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(1 << 10) + 1)
    texts = ["a b c!", "a a", "", None]
    got = ngram_model.score(pa.array(texts, pa.string()), weights, 10)
    for t, p in zip(texts, got):
        (_, data, offsets), = words.slices(pa.array([t], pa.string()))
        f = ngram_model.features(data, offsets, 10)[0]
        z = sum(weights[i] for i in f) / np.sqrt(max(1, len(f))) + weights[-1]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_rows_are_judged_well_and_never_learned_from(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    weights = quality.train(docs, labels)
    spoiled = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(weights, quality.train(docs, spoiled))
    rows = quality.score(docs, weights).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.93


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1), (5, 0), (5, None), (4, 3), (99, 1)], "doc_id long, quality int")
    weights = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, weights).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0
    assert {r.score for r in quality.score(odd_docs, quality.train(odd_docs, labels.limit(0))).collect()} == {0.5}
    assert quality.keep_good(odd_docs, weights).columns == odd_docs.columns


def plain_ftrl(examples, size, passes, seed, alpha=0.1, beta=1.0, l1=0.02, l2=1e-3):
    """The updates as published, with dictionaries and one number at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return -(z[i] - sign * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    ones = sum(label for _, label in examples)
    few, many = sorted((ones, len(examples) - ones))
    rare = int(ones < len(examples) - ones)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(examples)):
            found, label = examples[k]
            values = {int(i): found.tolist().count(i) / max(1, len(found)) ** 0.5 for i in set(found.tolist())} | {size: 1.0}
            w = {i: weight(i) for i in values}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in values.items())))
            for i, v in values.items():
                g = (p - label) * v * (min(4.0, max(many, 1) / max(few, 1)) if label == rare else 1.0)
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return np.array([weight(i) if i in z else 0.0 for i in range(size + 1)])


def test_training_matches_plain_updates():
    rng = np.random.default_rng(6)
    examples = [(rng.integers(0, 64, int(rng.integers(0, 30))), int(rng.random() < 0.2)) for _ in range(80)]
    got = ngram_model.train(examples, 6, passes=3, seed=9)
    assert np.count_nonzero(got) > 20
    np.testing.assert_allclose(got, plain_ftrl(examples, 64, 3, 9), rtol=1e-4, atol=1e-6)
