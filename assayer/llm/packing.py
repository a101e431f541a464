"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Texts are tokenised where they are read; only piece lengths are shuffled.  Pieces are dealt by hash
into blocks whose number follows from the number of documents alone, and each block is packed on its own:
longest first, each into the open bin that it fills best, found in a segment tree over remaining
capacities.  Best fit leaves a block at most one bin that is no more than half full; these bins of all
blocks are packed once more, as pieces of their own.  So the packing depends on the rows only, not on the
cluster or on how the rows were partitioned.

Defined cases: a null or empty text is its end id alone; a document longer than a sequence is cut
into full pieces and a last one; repeated rows are packed each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tokens
from assayer.storage import materialize

#: Pieces packed together at most; bounds a task's memory to some 20 MB.
BLOCK = 100_000
#: Documents for each block: few blocks waste few sequences, and a block takes seconds.
DOCUMENTS = 50_000


class CapacityTree:
    """Open bins by remaining capacity; ``tightest(n)`` is the least capacity >= n that a bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, capacity: int, number: int) -> None:
        if capacity:
            self.bins[capacity].append(number)
            self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.bins[capacity].pop()

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.leaves
        if self.open[at]:
            return need
        while at > 1:  # up to the first subtree to the right that has a bin, then down to its least leaf
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, taken in the given (descending) order, and the number of bins."""
    tree, bins = CapacityTree(capacity), 0
    number, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        room = tree.tightest(n)
        if room is None:
            room, found = capacity, bins
            bins += 1
        else:
            found = tree.take(room)
        number[i], offset[i] = found, capacity - room
        tree.put(room - n, found)
    return number, offset, bins


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise every whole text, add the end id, and cut it into pieces of at most ``capacity`` ids."""

    def cut(batches):
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            for at, ids, offsets in encode(batch.column(1), end_id):
                sizes = np.diff(offsets)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                first = offsets[row] + start
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def _pack_blocks(pieces: DataFrame, capacity: int, blocks: int, block: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, block by block.

    Blocks and the order in them depend on the rows alone, so a task that runs again packs alike.  A
    block that repeated rows make too large is packed in runs of ``block`` pieces.
    """
    if block > 1 << 17:
        raise ValueError("a run may have 2 ** 17 pieces at most")
    mark = F.xxhash64("id", "piece", "length", "ids_crc32")
    order = ["__block", "__mark", "id", "piece", "length", "ids_crc32"]
    placed = pieces.withColumns({"__mark": mark, "__block": F.pmod(mark, F.lit(blocks))})
    dealt = placed.repartition("__block").sortWithinPartitions(*order)

    def place(batches):
        held, rows, at, run = [], 0, None, 0

        def packed():
            part = pa.Table.from_batches(held).drop_columns(["__mark", "__block"])
            part = part.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            number, offset, bins = pack(part["length"].to_numpy(), capacity)
            # Block, run and bin in one number: a run has at most 2 ** 17 bins, a block 2 ** 19 runs.
            part = part.append_column("sequence_id", pa.array((at << 36) + (run << 17) + number)).append_column("offset", pa.array(offset))
            return part.to_batches()

        for batch in batches:
            while batch.num_rows:
                number = batch.column("__block").to_numpy()
                if number[0] != at or rows == block:
                    if held:
                        yield from packed()
                    run = run + 1 if number[0] == at else 0
                    held, rows, at = [], 0, int(number[0])
                to = min(int(np.searchsorted(number, at, side="right")), block - rows)
                held.append(batch.slice(0, to))
                rows += to
                batch = batch.slice(to)
        if held:
            yield from packed()

    return dealt.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, blocks: int = 1, block: int = BLOCK) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity``, dealt into ``blocks``."""
    packed = _pack_blocks(pieces, capacity, blocks, block)
    packed = materialize(packed, "packed")
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    # At most one a block or run: of two, best fit would have put the later one's first piece into the other.
    loose = materialize(used.filter(F.col("used") * 2 <= capacity), "loose-sequences")
    n = loose.count()
    if n < 2:
        return packed
    as_pieces = loose.select(F.col("sequence_id").alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.col("used").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    merged = _pack_blocks(as_pieces, capacity, -(-n // block), block)
    # Sequences of this second packing are numbered below zero.
    moved = merged.select(F.col("id").alias("sequence_id"), (-1 - F.col("sequence_id")).alias("into"), F.col("offset").alias("behind"))
    return packed.join(moved, "sequence_id", "left").select(
        *pieces.columns, F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("behind", F.lit(0))).alias("offset")
    )


def best_fit(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document."""
    blocks = max(1, -(-docs.count() // DOCUMENTS))
    return pack_pieces(cut_pieces(docs, tokenizer or tokens.default_path(), id_col, text_col, capacity, end_id), capacity, blocks)
