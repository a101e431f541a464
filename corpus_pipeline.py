"""A corpus pipeline of five stages, from raw documents to packed training sequences.

Each stage is handed what its predecessor kept and its decisions take effect; every result is written
as Parquet and read again by the next stage, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import exact_dedup, mixing, near_dup, packing, quality
from assayer.storage import fresh_path, scratch

#: Bytes of rows that a task hands to its Python worker at once (and a row more).  Spark's own 64 MB stand several
#: times over in the executor and in the worker, for each task that runs.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the session's Python tasks by BATCH, unless the session already has a bound of its own."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, BATCH)


def drop_poor_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the same corpus."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    index = exact_dedup.temporary_index(spark)
    kept = exact_dedup.keep_distinct(docs, index)
    index.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 over five words, the one with the least doc_id stays."""
    small_batches(spark)
    return near_dup.keep_one(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that sources have their target shares."""
    return mixing.emit(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its place in a sequence of 2048 tokens."""
    small_batches(spark)
    return packing.best_fit(docs, capacity=2048, end_id=0).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", drop_poor_texts),
    ("exact dedup", drop_exact_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier, a tokenizer and a bin packing have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a Parquet table of its own; what a stage wrote on the way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
