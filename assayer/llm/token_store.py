"""Token files: Arrow IPC files whose batches hold fixed-size lists, for zero-copy random access.

Ids are one stream in ascending document order, cut into sequences of equal length; column ``ids``
holds them, column ``mask`` is true where an id is text and false where the last sequence of a file
is padded.  All batches but a file's last hold the same number of sequences, so sequence ``s`` is row
``s % rows`` of batch ``s // rows``, and a memory-mapped reader copies nothing.

Each task writes one range of documents under a name of its own and moves it in place when whole; a
task that runs again writes the same bytes.  The manifest, a table, says where each document lies.

Defined cases: null texts are empty (their end id alone is stored); rows that share an id lie side by
side, ordered by their text's hash; an empty table gives an empty manifest; other columns are ignored.
Folders are reached through ``pyarrow.fs``, so any URI that it knows will do.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.storage import fresh_path, materialize

#: Ids in a sequence and sequences in a batch.
SEQUENCE, ROWS = 2048, 64
MANIFEST = "id long, file int, local_start long, n_tokens long"


def file_name(number: int) -> str:
    return f"part-{number:05d}.arrow"


class SequenceWriter:
    """Appends ids to one file, full batches as they come."""

    def __init__(self, sink, id_type: pa.DataType, sequence: int = SEQUENCE, rows: int = ROWS):
        self.sequence, self.rows, self.held, self.count = sequence, rows, [], 0
        self.id_type, self.dtype = id_type, id_type.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, kind), self.sequence) for x, kind in ((ids, self.id_type), (mask, pa.bool_()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.count += len(ids)
        full = self.sequence * self.rows
        if self.count >= full:
            ids = np.concatenate(self.held)
            for at in range(0, len(ids) - full + 1, full):
                self._write(ids[at : at + full], full)
            self.held = [ids[len(ids) // full * full :]]
            self.count = len(self.held[0])

    def close(self) -> None:
        if self.count:
            ids = np.concatenate(self.held)
            self._write(np.pad(ids, (0, -len(ids) % self.sequence)), len(ids))
        self.writer.close()


class SequenceReader:
    """Random access to one file; ``piece`` gives views of the mapped file for a range of ids."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.batch, self.at = None, -1
        self.full = self.reader.get_batch(0).num_rows * self.sequence if self.reader.num_record_batches else 0

    def piece(self, start: int, count: int) -> list[np.ndarray]:
        out = []
        while count:
            k, first = divmod(start, self.full)
            if k != self.at:
                self.at, self.batch = k, self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
            part = self.batch[first : first + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return out

    def close(self) -> None:
        self.batch = None
        self.source.close()


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, partitions: int | None = None) -> tuple[str, DataFrame]:
    """Write all documents' ids; the folder and its manifest ``id, file, local_start, n_tokens``."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    folder = folder or fresh_path(spark, "token-files")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = picked.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie")

    def write(batches):
        number, encoder, writer, at = TaskContext.get().partitionId(), tokens.encoder(tokenizer), None, 0
        store, root = fs.FileSystem.from_uri(folder)
        own = f"{root}/.{file_name(number)}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(own)
                writer = SequenceWriter(sink, pa.uint16() if encoder.vocabulary_size <= 1 << 16 else pa.uint32())
            for row, ids, offsets in encoder.encode(batch.column(1), end_id):
                writer.append(ids)
                sizes = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sizes)), pa.array(np.full(len(sizes), number), pa.int32()), pa.array(at + offsets[:-1]), pa.array(sizes)],
                    names=["id", "file", "local_start", "n_tokens"],
                )
                at += len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, f"{root}/{file_name(number)}")

    return folder, materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def global_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids of all documents before.  One row a file is summed up, then sent to all."""
    sizes = manifest.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("file", before.alias("base"))
    # As many rows as write_tokens had partitions.
    return manifest.join(F.broadcast(bases), "file").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` for the manifest's documents, their ids read from the files."""

    def read(batches):
        reader, held = None, None
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for file, start, count in zip(rows["file"], rows["local_start"], rows["n_tokens"]):
                if file != held:
                    if reader:
                        reader.close()
                    reader, held = SequenceReader(f"{folder}/{file_name(file)}"), file
                crc = 0
                for part in reader.piece(start, count):
                    crc = zlib.crc32(part.astype("<u4"), crc)
                out.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return global_starts(manifest).select("id", "file", "local_start", "n_tokens", "start").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")
