import numpy as np

from assayer.llm import embedding_dedup
from tests.llm.test_embeddings import brute


def scaled_rows():
    """A third of the rows are multiples of one vector, so that many pivots have one direction."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=64)
    rows = [(i, (base * (1 + 0.1 * i)).tolist()) for i in range(200)]
    rows += [(1000 + i, (base + rng.normal(size=64) * 0.05 * (1 + i % 8)).tolist()) for i in range(200)]
    return rows + [(2000 + i, rng.normal(size=64).tolist()) for i in range(200)]


def test_pivots_of_one_direction_lose_no_links(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 20), ("BLOCK", 32), ("RUN", 16)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = scaled_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pivots = embedding_dedup._pivots(embedding_dedup._classes(df, "vec_id", "embedding")[1])[64]
    assert (np.triu(pivots @ pivots.T, 1) > 1 - 1e-9).sum() >= 3
    # The cosine of near copies stands clear of the threshold by more than rounding.
    units = np.array([v for _, v in rows])
    units /= np.sqrt((units * units).sum(1, keepdims=True))
    assert np.abs(units @ units.T - 0.95).min() > 1e-12
    got = sorted((r.id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, 0.95).collect())
    assert got == brute(rows, 0.95)
