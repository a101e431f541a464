"""Where intermediate tables go: the shared folder that the session names.

On a cluster the driver and the executors share no local folder, so a cut in the lineage is a
Parquet table under ``spark.checkpoint.dir``.  Only in local mode, where driver and executors are one
process, may that setting be absent: then a temporary folder of this machine stands in for it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_fallback: dict[str, str] = {}
#: Paths handed out inside each open ``scratch`` block, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder, as a URI or path, that every process of this application can read and write."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.split("[")[0] == "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all processes share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, in folders by the columns ``by`` if there are any, and read it back.

    Later jobs then read files instead of running the plan again, and a lost executor costs a
    re-read at most.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parts:
    """A table that grows by parts, each written once: rounds of a loop add to it and read all that is there."""

    def __init__(self, spark: SparkSession, name: str, schema: StructType):
        self.spark, self.path, self.schema, self.written = spark, fresh_path(spark, name), schema, 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` as the next part and read that part back."""
        path = f"{self.path}/part={self.written}"
        rows.select(*self.schema.names).write.parquet(path)
        self.written += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        if not self.written:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={k}" for k in range(self.written)])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the intermediate tables that were made inside it.

    Results of the block must have been written elsewhere (or before it) by then.
    """
    _open.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _open.pop():
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
