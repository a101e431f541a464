"""Quality classifier: hashed word n-gram logistic regression, scored as sparse dot products.

Training takes a bounded sample of labelled texts (``SAMPLE`` rows, the first by a hash of their id, so
the same rows whatever the partitioning) and extracts their features in Spark; only those rows' feature
numbers reach the driver, where the updates run one example at a time, as the method has it.  Scoring
covers every whole text, a column at a time.

Defined cases: a null or empty text scores as the bias alone; labels that are null or other than 0
and 1, and labels of unknown documents, are not learned from; conflicting labels of a document are
learned each; without any label every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm import ngram_model, words

#: Labelled rows learned from at most, and weights: 2 ** BITS.
SAMPLE, BITS = 4000, 18
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    picked = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)  # bounded, so it can go to every task

    def extract(batches):
        for batch in batches:
            found, starts = [], [0]
            for _, data, offsets in words.slices(batch.column(1)):
                f, s = ngram_model.features(data, offsets, bits)
                found.append(f.astype(np.int32))
                starts += (starts[-1] + s[1:]).tolist()
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat)], names=["id", "label", "found"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select(F.col("id").cast("string"), "text", "label").mapInArrow(extract, "id string, label int, found array<int>")
    examples = rows.toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    found = examples.column("found").combine_chunks()
    values, ends = found.flatten().to_numpy(), found.offsets.to_numpy()
    ends = ends - ends[0] if len(ends) else ends
    parts = [(values[a:b], label) for a, b, label in zip(ends, ends[1:], examples.column("label").to_pylist())]
    return ngram_model.train(parts, bits).astype(np.float32)


def scorer(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> Callable[[Column], Column]:
    """A column function from text to the probability of label 1.  The weights sent have a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return pa.array(ngram_model.score(texts, sent.value, bits))

    return quality


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` for every row."""
    scored = docs.select(F.col(id_col).alias("id"), scorer(docs, weights)(F.col(text_col).cast("string")).alias("score"))
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model accepts, with all their columns."""
    good = scorer(docs, weights)(F.col(text_col).cast("string"))
    return docs.withColumn("__good", good).filter(F.col("__good") >= threshold).drop("__good")
