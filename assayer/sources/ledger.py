"""A table that grows by named batches, each of which counts whole or not at all.

A batch's rows are written under a folder of their own, then a manifest of a few bytes is put in its final place by one
rename, and only batches with a manifest are read.  A writer that dies leaves rows without a manifest, which no
reader sees and the next run of the batch overwrites; a batch that has its manifest is not written again.  So a
batch can be retried at any time, and one writer at a time may use a ledger.

Layout: ``data/batch=<name>/...`` in Parquet, dealt by the partition columns, and ``manifest/<name>.json``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.operators import integrity
from assayer.storage import materialize

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
#: Folders that rows of a batch are dealt over by their case, whatever the number of cases.
PARTS = 16


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition: list[str] | None = None):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition or []

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifests(self) -> dict[str, dict]:
        """What was said of each batch when it was committed, in order of commit."""
        folder, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return {}
        found = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = fs.open(status.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found.append((status.getModificationTime(), name.removesuffix(".json"), json.loads(text)))
        return {name: said for _, name, said in sorted(found, key=lambda x: x[:2])}

    def _commit(self, batch: str, said: dict) -> None:
        """Write the manifest beside its place and rename it: the batch is there from then on."""
        staged, fs = self._fs(f"{self.path}/manifest/.{batch}.json.tmp")
        final, _ = self._fs(f"{self.path}/manifest/{batch}.json")
        out = fs.create(staged, True)
        out.write(json.dumps(said, sort_keys=True).encode())
        out.close()
        if not fs.rename(staged, final):
            raise OSError(f"batch {batch} could not be committed")

    def rows(self, batches: list[str] | None = None) -> DataFrame:
        """Rows of all committed batches, or of some of these, with ``batch``."""
        known = list(self.manifests())
        names = known if batches is None else [b for b in batches if b in known]
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(""))
        paths = [f"{self.path}/data/batch={name}" for name in names]
        read = StructType([*self.schema.fields]).add("batch", "string")
        return self.spark.read.schema(read).option("basePath", f"{self.path}/data").parquet(*paths)

    def append(self, batch: str, make: Callable[[], DataFrame], **said) -> bool:
        """Commit the rows that ``make`` gives under the name ``batch``; false, and nothing done, if that is committed."""
        if not NAME.fullmatch(batch):
            raise ValueError(f"a batch's name is made of letters, digits, - and _: {batch!r}")
        if batch in self.manifests():
            return False
        path = f"{self.path}/data/batch={batch}"
        rows = make().select(*self.schema.names)
        if self.partition:
            rows = rows.repartition(*self.partition)
        rows.write.mode("overwrite").partitionBy(*self.partition).parquet(path)
        written = self.spark.read.schema(self.schema).parquet(path).count()
        self._commit(batch, {"rows": written} | said)
        return True


def case_part(case_id: Column) -> Column:
    """The folder that a case's records lie in."""
    return F.pmod(F.xxhash64(case_id.cast("string")), F.lit(PARTS)).cast("int")


class History:
    """Records by case, each id once: a record whose id an earlier batch or an earlier record brought is refused.

    Refused records are kept too, marked as such, under the same commit.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str, case: str = "case_id"):
        self.keys, self.order, self.case = keys, order, case
        self.ledger = Ledger(spark, path, StructType([*schema.fields]).add("accepted", "boolean").add("case_part", "integer"), ["accepted", "case_part"])

    def rows(self) -> DataFrame:
        """``accepted, batch`` and the records' columns."""
        return self.ledger.rows().drop("case_part")

    def append(self, batch: str, new: DataFrame) -> bool:
        """Judge ``new`` against all committed batches and commit it; false if it is committed already."""

        def decided() -> DataFrame:
            accepted, refused = integrity.append_history(new, self.ledger.rows().filter("accepted"), self.keys, self.order)
            both = accepted.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
            return both.withColumn("case_part", case_part(F.col(self.case)))

        return self.ledger.append(batch, decided)


def export_bundles(manifest: DataFrame, observed: DataFrame, ledger: Ledger, batch: str) -> DataFrame:
    """Write the bundles of ``manifest`` that are whole, and return ``bundle_id, path, ok, bundle_ok`` for every row.

    Of a bundle with any mismatch or missing artifact nothing is written.  The decision is written first and read
    again, so what is returned is what the files were made by.
    """
    decided = materialize(integrity.export_inventory(manifest, observed), "bundles")
    whole = decided.filter("bundle_ok").select("bundle_id", "path")
    ledger.append(batch, lambda: manifest.join(whole, ["bundle_id", "path"], "left_semi").withColumn("bundle_part", case_part(F.col("bundle_id"))))
    return decided
