"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, one row per distinct text, with the batch that brought
it.  A batch is reduced to one row per digest (combined before its shuffle) and sort-merge anti-joined with
what earlier batches brought; the digests that are new are appended under the batch's name.  A batch that
runs again, be it after a crash between the append and the result, is judged against the other batches
alone and appends only what is missing, so it gets the same answer and the index the same rows.

``deduplicate`` ingests a corpus in several batches, each a range of ids, the largest ids first: of equal
texts the largest id is then in the index before the others meet it.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z
only; of equal texts in a corpus the row with the largest id stays (null ids lose to all others);
rows that repeat both id and text are reported each, and count each in ``group_size``; a digest that
another corpus brought before drops the whole group.  An empty corpus gives an empty result.  Extra
columns are ignored, whatever they are called.  One writer at a time may ingest into an index.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.skew import join_counted
from assayer.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches that a corpus is ingested in.
BATCHES = 2


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, nothing else; null becomes empty.

    ``lower`` also maps other letters, so it serves only where all characters are ASCII.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the normalised text in UTF-8."""
    return F.unhex(F.sha2(lower_ascii(text), 256))


class DigestIndex:
    """A bucketed table ``(digest, keep_id, batch)``, sorted by digest within each bucket."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        """``buckets`` counts for a table that does not exist yet; pick it for the size the index will
        reach (about 5 million digests a bucket)."""
        self.spark, self.table = spark, table
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], "digest binary, keep_id long, batch string"), "errorifexists")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, groups: DataFrame, batch: str) -> DataFrame:
        """Decide ``groups(digest, keep_id, ...)``, one row each, and append those that are new.

        Returns the groups with ``is_new`` and, where that is false, the ``keep_id`` that the index holds.
        The decision is written to the shared folder first, so that a retried append sees the same rows.
        """
        held = self.rows()
        groups = materialize(groups, "batch-digests")  # else the join would be done before the rows are combined
        others = held.filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("held_id")).hint("merge")
        decided = fresh = materialize(groups.join(others, "digest", "left_anti").withColumn("is_new", F.lit(True)), "new-digests")
        if not others.isEmpty():
            old = groups.join(others, "digest").withColumns({"keep_id": F.col("held_id"), "is_new": F.lit(False)}).drop("held_id")
            decided = fresh.unionByName(materialize(old, "old-digests"))
        own = held.filter(F.col("batch") == batch).select("digest")
        if not own.isEmpty():  # the batch runs again
            fresh = fresh.join(own.hint("merge"), "digest", "left_anti")
        self._write(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest"), "append")
        return decided


def temporary_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own for one run over one corpus; ``drop`` it afterwards."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "corpus", parts: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, digest, keep_id, group_size, kept``.

    ``keep_id`` is the id of the row that stays: of this corpus, or the one in the index if that had the
    text already (then no row of the corpus is kept).  The corpus is ingested in ``parts`` batches named
    after ``batch``; a call with the same name and rows gives the same answer.  All decisions are made
    when this returns, so the index may be dropped.
    """
    digests = materialize(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    low, high, total = digests.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    cuts = [] if low is None else [high - (high - low) // parts * k for k in range(1, parts)]
    place = reduce(lambda c, k: c.when(F.col("id") >= cuts[k], k), range(len(cuts)), F.when(F.lit(False), 0)).otherwise(len(cuts))
    placed = digests.withColumn("part", place)
    decided = []
    for k in range(len(cuts) + 1):
        groups = placed.filter(F.col("part") == k).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        decided.append(index.ingest(groups, f"{batch}/{k}"))
    # A later batch finds the digest of an earlier one in the index, with the id that stays.
    whole = reduce(DataFrame.unionByName, decided).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bool_or("is_new").alias("is_new")
    )
    found = join_counted(digests, materialize(whole, "digest-groups"), "digest", "group_size", total)
    return found.select("id", "digest", "keep_id", "group_size", (F.col("is_new") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def keep_distinct(docs: DataFrame, index: DigestIndex, batch: str = "corpus", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one."""
    keys = {"__no_id": F.col("__id").isNull(), "__id": F.coalesce("__id", F.lit(0))}
    found = deduplicate(docs, index, batch, id_col=id_col, text_col=text_col)
    kept = found.filter("kept").select(F.col("id").alias("__id"), F.col("digest").alias("__digest")).withColumns(keys).distinct()
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__digest": text_digest(F.col(text_col))}).withColumns(keys)
    # The join leaves the rows dealt and sorted as the numbering wants them.
    on = ["__no_id", "__id", "__digest"]
    one = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    return keyed.join(kept, on, "left_semi").withColumn("__row", one).filter("__row = 1").drop(*on, "__row")
