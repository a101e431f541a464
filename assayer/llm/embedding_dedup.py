"""Near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= c is distance <= e with e = sqrt(2 - 2c), so the triangle inequality holds.
Pivots are drawn from the vectors; each vector lives in the cell of its nearest pivot and is copied to
every cell whose boundary it may reach across: if x lives with pivot p and y is within e of x, then
d(y, p) <= d(y, its own pivot) + 2e.  So each cell finds all partners of its residents on its own.
Candidates are compared in double precision by the cosine itself; the distances only carry slack for
rounding.  In a cell, distances to the pivot bound distances between vectors once more.

Equal vectors are one class, so a huge group of copies is one row; a cell is cut into blocks of
residents, each of which meets all of the cell in runs, so no task holds an unbounded group.  Tasks
return link counts and a spanning forest of what they found, not all pairs.

Defined cases: null, empty, zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths never link; ids that repeat count as vectors each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import components
from assayer.operators.skew import join_counted
from assayer.storage import materialize

#: Classes for each pivot, pivots at most, residents of a block, and vectors compared with a block at once.
PER_PIVOT, MOST_PIVOTS, BLOCK, RUN = 4000, 256, 4096, 1024
SLACK = 1e-6
#: Pivots nearer to each other than this have no plane between them that rounding leaves usable.
APART = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest component first, so that squares neither vanish nor overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _units(rows: pa.RecordBatch) -> np.ndarray:
    """Unit vectors in doubles from column ``v``: bytes of singles where those are exact, else of doubles."""
    dim = rows.column("dim")[0].as_py()
    values = rows.column("v").to_pylist()
    out = np.empty((len(values), dim))
    for i, v in enumerate(values):
        out[i] = np.frombuffer(v, dtype=np.float32 if len(v) == 4 * dim else np.float64)
    return unit(out)


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, id, node`` and classes of equal usable vectors ``node, many, dim, v`` (bytes of doubles)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    some = F.coalesce(F.exists(x, lambda e: e != 0), F.lit(False))
    # Negative zeros would tell equal vectors apart; adding zero makes them positive.
    rows = vectors.select(F.col(id_col).alias("id"), F.when(finite & some, F.transform(x, lambda e: e + F.lit(0.0))).alias("v"))
    # 128 bits stand for a vector as a key.
    keys = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(2), F.col("v")), "row": F.monotonically_increasing_id()}
    rows = materialize(rows.withColumns(keys), "vectors")
    usable = rows.filter("v is not null")
    groups = materialize(usable.groupBy("h", "g").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v")), "classes")
    total = groups.agg(F.sum("many")).first()[0] or 0
    members = join_counted(usable.select("row", "id", "h", "g"), groups.select("h", "g", "node", "many"), ["h", "g"], "many", total)
    none = rows.filter("v is null").select("row", "id", F.lit(None).cast("long").alias("node"))
    members = members.select("row", "id", "node").unionByName(none)

    def pack(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            single = flat.astype(np.float32)
            exact = single == flat
            values = [(single if exact[a:b].all() else flat)[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("many"), pa.array(np.diff(ends), pa.int32()), pa.array(values, pa.binary())], names=["node", "many", "dim", "v"])

    return members, materialize(groups.mapInArrow(pack, "node long, many long, dim int, v binary"), "units")


def _pivots(classes: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: a bounded number of classes, chosen by hash."""
    count = classes.count()
    n = max(1, min(MOST_PIVOTS, count // PER_PIVOT))
    drawn = classes.orderBy(F.xxhash64("node"), "node").limit(n).select("dim", "v").toArrow().combine_chunks()
    dims = drawn.column("dim").to_numpy()
    return {int(d): _units(drawn.filter(pa.array(dims == d)).combine_chunks().to_batches()[0]) for d in np.unique(dims)}


def _homes(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``dim, cell`` of every class: its nearest pivot."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def find(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                home = _distances(_units(part), sent.value.get(int(dim), np.eye(1, dim))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(home.astype(np.int32))], names=["dim", "cell"])

    return classes.select("dim", "v").mapInArrow(find, "dim int, cell int")


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def _placed(classes: DataFrame, pivots: dict[int, np.ndarray], reach: float) -> DataFrame:
    """A row for each cell that a class is in: ``dim, cell, resident, far`` (distance to the pivot)."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most

    def place(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _units(part)
                p = sent.value.get(int(dim), np.eye(1, dim))
                far = _distances(x, p)
                home = far.argmin(axis=1)
                near = far[np.arange(len(x)), home]
                # Two ways to rule a cell out; both hold, so the nearer bound counts.
                gap = _distances(p, p)[home]
                # Pivots of (almost) one direction, v and 3v say, leave the first alone.
                plane = gap > APART
                across = (far**2 - near[:, None] ** 2) / np.where(plane, 2 * gap, 1.0)  # distance to the plane between the pivots
                reached = (far <= near[:, None] + 2 * reach + SLACK) & ~(plane & (across > reach + SLACK))
                reached[np.arange(len(x)), home] = True
                row, cell = np.nonzero(reached)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("node"), taken.column("many"), taken.column("dim"), taken.column("v"), pa.array(cell.astype(np.int32)), pa.array(cell == home[row]), pa.array(far[row, cell])],
                    names=["node", "many", "dim", "v", "cell", "resident", "far"],
                )

    return classes.mapInArrow(place, "node long, many long, dim int, v binary, cell int, resident boolean, far double")


class Block:
    """Residents of a cell, their link counts, and which of them are known to be connected."""

    def __init__(self, rows: pa.RecordBatch, cosine: float, reach: float):
        self.cosine, self.reach = cosine, reach
        order = np.argsort(rows.column("far").to_numpy(), kind="stable")
        self.far, self.node = rows.column("far").to_numpy()[order], rows.column("node").to_numpy()[order]
        self.x = _units(rows)[order]
        self.links, self.root = np.zeros(len(order), dtype=np.int64), list(range(len(order)))

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def meet(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Count links with ``rows``; edges that connect each linked row, and residents that it joins."""
        far, node, many, y = rows.column("far").to_numpy(), rows.column("node").to_numpy(), rows.column("many").to_numpy(), _units(rows)
        order = np.argsort(far, kind="stable")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), RUN):
            run = order[at : at + RUN]
            # |d(x, p) - d(y, p)| <= d(x, y): only residents of this ring can be near.
            lo = np.searchsorted(self.far, far[run[0]] - self.reach - SLACK)
            hi = np.searchsorted(self.far, far[run[-1]] + self.reach + SLACK, side="right")
            if lo == hi:
                continue
            # The product proposes; the cosine decides, summed alike for all pairs.
            right, left = np.nonzero(y[run] @ self.x[lo:hi].T >= self.cosine - SLACK)
            left, right = left + lo, run[right]
            good = (np.einsum("ij,ij->i", self.x[left], y[right]) >= self.cosine) & (self.node[left] != node[right])
            left, right = left[good], right[good]
            np.add.at(self.links, left, many[right])
            seen, first, back = np.unique(right, return_index=True, return_inverse=True)
            a.append(self.node[left[first]])
            b.append(node[seen])
            for i, j in np.unique(np.stack([left[first][back], left]), axis=1).T.tolist() if len(left) else ():
                p, q = self._find(i), self._find(j)
                if p != q:
                    self.root[p] = q
                    a.append(self.node[i : i + 1])
                    b.append(self.node[j : j + 1])
        return np.concatenate(a), np.concatenate(b)


def _links(classes: DataFrame, cosine: float, reach: float) -> DataFrame:
    """``a, b, links``: partial link counts of ``a`` (``b`` null) and edges that connect what links (``links`` null)."""
    keys = ["dim", "cell"]
    pivots = _pivots(classes)
    sizes = materialize(_homes(classes, pivots).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cell-sizes")
    placed = _placed(classes, pivots, reach)
    # A cell's residents are dealt to blocks; every row of the cell visits each of its blocks.
    cells = placed.join(sizes, keys).withColumn("own", F.when(F.col("resident"), F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int"))
    visits = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = visits.withColumn("here", F.coalesce(F.col("own") == F.col("block"), F.lit(False))).select("dim", "cell", "block", "here", "far", "node", "many", "v")
    dealt = visits.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", F.desc("here"), "far", "node")

    def compare(batches):
        key, residents, block = None, [], None

        def out(a, b, links):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], names=["a", "b", "links"])

        def edges(found):
            return out(found[0], found[1], [None] * len(found[0]))

        def settle():
            rows = pa.Table.from_batches(residents).combine_chunks().to_batches()[0]
            made = Block(rows, cosine, reach)
            return made, edges(made.meet(rows))

        def finish():
            nonlocal block
            if key is not None:
                if block is None:
                    block, found = settle()
                    yield found
                yield out(block.node, [None] * len(block.node), block.links)

        for batch in batches:
            k = [batch.column(c).to_numpy() for c in ("dim", "cell", "block")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1 if batch.num_rows else []
            cuts = [0, *change, batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                part, now = batch.slice(at, to - at), tuple(int(c[at]) for c in k)
                if now != key:
                    yield from finish()
                    key, residents, block = now, [], None
                here = part.column("here")
                if (own := part.filter(here)).num_rows:  # residents come first
                    residents.append(own)
                if own.num_rows < part.num_rows:
                    if block is None:
                        block, found = settle()
                        yield found
                    yield edges(block.meet(part.slice(own.num_rows)))
        yield from finish()

    return dealt.mapInArrow(compare, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` for every row."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    members, classes = _classes(vectors, id_col, vector_col)
    members = materialize(members, "members")
    found = materialize(_links(classes, cosine, reach), "vector-links")
    counted = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    roots = components.connected(found.filter("b is not null").select("a", "b"))
    nodes = materialize(classes.select("node", "many").join(counted, "node", "left").join(roots, "node", "left").select("node", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "nodes")
    placed = members.join(nodes, "node", "left")
    least = placed.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    done = placed.join(least, "root", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return done.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
