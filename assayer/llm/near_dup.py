"""N-gram Jaccard join: texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Method.  A text becomes a sorted array of shingle hashes.  Two sets that reach the threshold share one
of their first few shingles in any common order, and their sizes lie in one band or in two that adjoin, so
sets meet in tiles keyed by such a shingle and a size band: each set is at home in the tile of its band and
a guest in that of the next band up, where it meets those at home.  Rows carry a hashed bitmap in which every shingle flips one bit: two bitmaps differ in at most as many bits as
the sets differ in shingles, so a bit count bounds the overlap from above.  Pairs within the bound are
intersected exactly.  No sampling, no cap: the components are those of comparing all pairs.  Links are not
enumerated: pairs inside a component that is already known are not looked for.

Skew.  Equal sets are one class from the start.  The common order puts shingles of many texts last
(a bounded list of the most frequent ones), so a line in a third of all texts makes no tile.  Large
groups of near copies are first joined by a few leaders drawn for each min-hash, then by each row's
nearest partner in large tiles; a tile whose rows are all of one component has nothing to add and is
dropped.  Tiles that are still large are split into blocks, and blocks meet pairwise in tasks of their own.

Defined cases: null, empty and blank texts have the empty set, which links with nothing; texts shorter
than a shingle are one shingle of all their words; every row is compared, also if its id is null or another
row's; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm import components, words
from assayer.operators.skew import join_counted
from assayer.storage import materialize

#: A shingle at the head of so many texts goes to the end of the order, if among the most frequent so many.
FREQUENT, FREQUENT_MOST = 256, 200_000
#: Rows of a block of a tile; min-hash leaders drawn per round, and rounds.
BLOCK, ROUNDS = 512, 2
PAIRS_AT_ONCE = 250_000
#: Rows from which a tile counts as large, and large tiles in which a row looks for its nearest partner.
LARGE, NEAREST_TILES = 32, 4
#: Bits of the filter that says which texts are read again for their sets (a wrong hit costs time only).
FILTER_BITS = 1 << 22

#: Bits of the smallest bitmaps: with four bits a shingle and more, hardly a pair below the threshold passes.
LEAST_BITS = 1024

PERMUTE = np.array([0xD6E8FEB86659FD93, 0xCA5A826395121157, 0xBE4BA423396CFEB8 | 1], dtype=np.uint64)


def head_size(n: int, percent: int) -> int:
    """How many first shingles a set of ``n`` must show."""
    return n - -(-percent * n // 100) + 1 if n else 0


def width(n: int) -> int:
    """Bits of the bitmap of a set of ``n``: a power of two from ``n`` on, LEAST_BITS at least."""
    return max(LEAST_BITS, 1 << max(0, n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> bytes:
    bits = width(len(shingles))
    counts = np.bincount((shingles >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def overlap_reaches(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether ``both`` shared shingles make ``percent`` of the union of sets of ``a`` and ``b``."""
    return 100 * both >= percent * (a + b - both)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def frequent_shingles(texts: DataFrame, size: int, percent: int) -> np.ndarray:
    """The most frequent shingles among the heads of all texts, sorted; at most FREQUENT_MOST."""

    def count(batches):
        for batch in batches:
            heads = []
            for _, data, offsets in words.slices(batch.column(0)):
                heads += [s[: head_size(len(s), percent)] for s in words.shingle_sets(data, offsets, size)]
            found, n = np.unique(np.concatenate(heads) if heads else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    counted = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    most = counted.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST)
    return np.sort(np.array([r.shingle for r in most.select("shingle").collect()], dtype=np.int64).view(np.uint64))


SKETCH = "id long, mark long, n int, digest binary, bits binary, minima array<long>, head array<long>"


def sketches(texts: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """A row per text: set size, digest, bitmap, three min-hashes, and the head in the common order."""
    late = texts.sparkSession.sparkContext.broadcast(frequent)

    def sketch(batches):
        last = late.value
        for batch in batches:
            for at, data, offsets in words.slices(batch.column(1)):
                sets = words.shingle_sets(data, offsets, size)
                out = {"n": [], "digest": [], "bits": [], "minima": [], "head": []}
                for s in sets:
                    n = len(s)
                    out["n"].append(n)
                    if not n:
                        for k in ("digest", "bits", "minima", "head"):
                            out[k].append(None)
                        continue
                    out["digest"].append(digest(s))
                    out["bits"].append(bitmap(s))
                    out["minima"].append(np.array([(s * p).min() ^ p for p in PERMUTE], dtype=np.uint64).view(np.int64))
                    k = head_size(n, percent)
                    if len(last):
                        is_late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        early = s[~is_late]
                        s = early if len(early) >= k else np.concatenate([early, s[is_late]])
                    out["head"].append(s[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)), batch.column(2).slice(at, len(sets)), pa.array(out["n"], pa.int32()),
                        pa.array(out["digest"], pa.binary()), pa.array(out["bits"], pa.binary()),
                        pa.array(out["minima"], pa.list_(pa.int64())), pa.array(out["head"], pa.list_(pa.int64())),
                    ],
                    names=["id", "mark", "n", "digest", "bits", "minima", "head"],
                )

    return texts.mapInArrow(sketch, SKETCH)


def fold(bits: np.ndarray, count: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to ``count`` words: halves are added bit by bit."""
    while bits.shape[1] > count:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def bit_distance(n: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For index pairs (left, right), the least share of their shingles that differs by the bitmaps.

    Infinite for pairs that cannot reach the threshold by size and bitmap.
    """
    a, b = n[left], n[right]
    keep = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    left, right, places = left[keep], right[keep], np.flatnonzero(keep)
    sizes = np.array([len(x) // 8 for x in bits])
    table = {}
    for w in np.unique(sizes[np.concatenate([left, right])]) if len(left) else ():
        rows = np.flatnonzero(sizes == w)
        index = np.full(len(bits), -1)
        index[rows] = np.arange(len(rows))
        table[w] = (np.frombuffer(b"".join(bits[i] for i in rows), dtype=np.uint64).reshape(len(rows), w), index)
    out = np.full(len(a), np.inf)
    wl, wr = sizes[left], sizes[right]
    for x, y in {(x, y) for x, y in zip(wl.tolist(), wr.tolist())}:
        here = np.flatnonzero((wl == x) & (wr == y))
        step = max(1, (1 << 20) // max(x, y))
        for at in range(0, len(here), step):
            part = here[at : at + step]
            p, q = table[x][0][table[x][1][left[part]]], table[y][0][table[y][1][right[part]]]
            differ = np.bitwise_count(fold(p, min(x, y)) ^ fold(q, min(x, y))).sum(axis=1, dtype=np.int64)
            na, nb = n[left[part]], n[right[part]]
            most = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))
            out[places[part]] = np.where(overlap_reaches(na, nb, most, percent), differ / (na + nb), np.inf)
    return out


def within_bound(n: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which index pairs may reach the threshold by size and bitmap."""
    return np.isfinite(bit_distance(n, bits, left, right, percent))


def bounded_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that sizes and bitmaps let through."""

    def keep(batches):
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()]).astype(np.int64)
            bits = batch.column("bits_a").to_pylist() + batch.column("bits_b").to_pylist()
            good = within_bound(n, bits, np.arange(m), np.arange(m, 2 * m), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    with_a = pairs.join(classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = with_a.join(classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")), "b")
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * F.lit(percent)
    return both.filter(near).mapInArrow(keep, "a long, b long")


def shingle_arrays(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` for ``nodes(node, id, digest)``: their texts are read again.

    A bitmap of fixed size over their ids, built in Spark, spares other texts the hashing; the join
    by digest then decides.
    """
    spark = texts.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # bitmap buckets count from 1
    rows = nodes.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    wanted = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r.bucket - 1) * len(r.bits)
        wanted[at : at + len(r.bits)] = np.frombuffer(r.bits, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(wanted)

    def read(batches):
        held = sent.value
        for batch in batches:
            p = batch.column(1).to_numpy() - 1
            batch = batch.filter(pa.array((held[p // 8] >> (p % 8)) & 1 == 1))
            for _, data, offsets in words.slices(batch.column(0)):
                sets = [s for s in words.shingle_sets(data, offsets, size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "shingles"])

    found = texts.select("text", place.alias("p")).mapInArrow(read, "digest binary, shingles binary")
    return found.join(nodes.select("node", "digest"), "digest").select("node", "shingles").dropDuplicates(["node"])


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sorted arrays reach the threshold."""

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good.append(overlap_reaches(len(p), len(q), both, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(arrays.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(arrays.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.mapInArrow(check, "a long, b long")


def leader_pairs(classes: DataFrame) -> DataFrame:
    """Each class with a few leaders: for each of its min-hashes, a class drawn among those that share it."""
    keys = classes.select("node", F.explode("minima").alias("key"))
    pairs = []
    for draw in range(ROUNDS):
        leaders = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(draw), "node").alias("h"), "node"))["node"].alias("leader"), F.count(F.lit(1)).alias("many")).filter("many > 1")
        pairs.append(keys.join(leaders.drop("many"), "key").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")))
    return reduce(DataFrame.unionByName, pairs).filter("a < b").distinct()


def shared_heads(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``shingle, node, n``: head shingles of classes of two components or more."""
    rooted = with_root(classes.select("node", "head"), roots).select(F.explode("head").alias("shingle"), "root")
    counted = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many"))
    shared = materialize(counted.filter("low < high").select("shingle", "many"), "shared-shingles")
    total = shared.agg(F.sum("many")).first()[0] or 0
    return join_counted(classes.select(F.explode("head").alias("shingle"), "node", "n"), shared, "shingle", "many", total).drop("many")


def size_band(n: Column, percent: int) -> Column:
    """The band of a set of ``n``: sizes that may reach the threshold lie in one band or in two that adjoin.

    Bands are wider than the threshold asks for by far more than logarithms are rounded.
    """
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    return F.floor(F.log(n) / F.lit(width)).cast("int")


def banded(heads: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``shingle, band, guest, node, many``: each class in the tiles of its band and of the next one up.

    Tiles of one component, and those where all are guests, are left out; ``many`` is a tile's number of classes.
    """
    band = size_band(F.col("n"), percent)
    places = F.inline(F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest"))))
    placed = heads.select("shingle", "node", places)
    met = with_root(placed, roots).groupBy("shingle", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("guest").alias("guests"), F.count(F.lit(1)).alias("many"))
    tiles = materialize(met.filter("low < high and not guests").select("shingle", "band", "many"), "banded-tiles")
    total = tiles.agg(F.sum("many")).first()[0] or 0
    return join_counted(placed, tiles, ["shingle", "band"], "many", total)


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def nearest(left: np.ndarray, right: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the nearest one of their left or of their right row."""
    order = np.argsort(distance, kind="stable")
    return np.unique(np.concatenate([order[np.unique(side[order], return_index=True)[1]] for side in (left, right)]))


def tile_pairs(heads: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Pairs of classes of different components that meet in a tile and pass size and bitmap.

    With ``best``, only each row's nearest one in each tile.
    """
    met = with_root(heads, roots).join(classes.select("node", "n", "bits"), "node").withColumn("blocks", F.ceil(F.col("many") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Block b meets block c in the tile (least, greatest); a tile of one block holds its rows once.
    placed = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).select("shingle", "band", "x", "y", "own", "guest", "node", "root", "n", "bits")
    tiles = placed.repartition("shingle", "band", "x", "y").sortWithinPartitions("shingle", "band", "x", "y", "node")

    def compare(rows: pa.Table, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside tiles, given where tiles begin and end: each row with all later rows of its tile."""
        own, x, y, root, n, node = (rows.column(c).to_numpy() for c in ("own", "x", "y", "root", "n", "node"))
        guest = rows.column("guest").to_numpy()
        n, bits = n.astype(np.int64), rows.column("bits").to_pylist()
        later = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(cuts[0], cuts[-1]) - 1
        ends, found = np.cumsum(later), [np.zeros((2, 0), np.int64)]
        at = 0
        while at < len(later):  # PAIRS_AT_ONCE pairs or one row's
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            count = later[at:to]
            left = np.repeat(np.arange(at, to), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            keep = (root[left] != root[right]) & ~(guest[left] & guest[right]) & ((x[left] == y[left]) | (own[left] != own[right]))
            left, right = left[keep], right[keep]
            distance = bit_distance(n, bits, left, right, percent)
            good = np.flatnonzero(np.isfinite(distance))
            if best:
                good = good[nearest(left[good], right[good], distance[good])]
            found.append(np.sort(np.stack([node[left[good]], node[right[good]]]), axis=0))
            at = to
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def walk(batches):
        """Tiles lie whole and in order in a partition; the last of a batch may go on in the next."""
        held = None
        names = ["shingle", "band", "x", "y"]

        def compared(table: pa.Table, whole: bool):
            keys = [table.column(c).to_numpy() for c in names]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *change.tolist(), table.num_rows]
            ends = np.array(cuts if whole else cuts[:-1])
            a, b = compare(table.slice(0, ends[-1]), ends)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]), table.slice(ends[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if table.num_rows:
                out, held = compared(table, whole=False)
                yield out
        if held is not None and held.num_rows:
            yield compared(held, whole=True)[0]

    return tiles.mapInArrow(walk, "a long, b long").distinct()


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``row, id, mark, n, root`` for every row: a hash of its text, its set size, and its component (null without shingles)."""
    texts = _texts(docs, id_col, text_col)
    rows = materialize(sketches(texts, size, percent, frequent_shingles(texts, size, percent)).withColumn("row", F.monotonically_increasing_id()), "sketches")
    groups = materialize(rows.filter("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("many")), "groups")
    total = groups.agg(F.sum("many")).first()[0] or 0
    members = join_counted(rows.filter("n > 0").select("row", "id", "mark", "n", "digest"), groups, "digest", "many", total)
    members = materialize(members.select("row", "id", "mark", "n", "node"), "members")
    firsts = members.filter("row = node").select("row")
    classes = materialize(rows.join(firsts, "row", "left_semi").withColumnRenamed("row", "node"), "classes")

    def links(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        pairs = materialize(pairs, "bounded-pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if known is not None:
            nodes = nodes.join(known.select("node"), "node", "left_anti")
        wanted = materialize(nodes.join(classes.select("node", "id", "digest"), "node"), "wanted")
        arrays = shingle_arrays(texts, wanted, size)
        arrays = materialize(arrays, "arrays")
        arrays = arrays if known is None else known.unionByName(arrays)
        return verified(pairs, arrays, percent), arrays

    found, arrays = links(bounded_pairs(leader_pairs(classes), classes, percent), None)
    found = materialize(found, "links")
    roots = components.connected(found)
    heads = materialize(shared_heads(classes, roots), "heads")
    heads = materialize(banded(heads, roots, percent), "banded-heads")
    # In a few of its large tiles each row first meets its nearest partner; groups that this joins need no further pairs.
    large = heads.filter(F.col("many") > LARGE)
    few = large.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("guest", "shingle", "band", "many"))), 1, NEAREST_TILES).alias("first"))
    near, arrays = links(tile_pairs(few.select("node", F.inline("first")), classes, roots, percent, best=True), arrays)
    found = found.unionByName(materialize(near, "links"))
    roots = components.connected(found)
    tile = ["shingle", "band"]
    still = with_root(large, roots).groupBy(*tile).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select(*tile)
    left = heads.filter(F.col("many") <= LARGE).unionByName(large.join(still, tile, "left_semi"))
    more, _ = links(tile_pairs(left, classes, roots, percent), arrays)
    roots = components.connected(found.unionByName(materialize(more, "links")))

    rooted = materialize(with_root(groups.select("node", "many"), roots), "rooted")
    placed = join_counted(members, rooted, "node", "many", total).select("row", "id", "mark", "n", "root")
    return materialize(placed.unionByName(rows.filter("n = 0").select("row", "id", "mark", "n", F.lit(None).cast("long").alias("root"))), "placed")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row: the least id that links lead to.

    ``size`` words a shingle; two sets link when they share ``percent`` of their union.
    """
    placed = _components(docs, size, percent, id_col, text_col)
    linked = placed.filter("root is not null")
    least = materialize(linked.groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many")), "components")
    total = least.agg(F.sum("many")).first()[0] or 0
    found = join_counted(linked, least, "root", "many", total).select("id", "n", "least")
    found = found.unionByName(placed.filter("root is null").select("id", "n", F.col("id").alias("least")))
    return found.select("id", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the least id, null ids last; rows without shingles all stay.

    Rows are told apart by id and text, so rows that share an id only are judged each; of rows that repeat both, one stays.
    """
    keys = {"__no_id": F.col("__id").isNull(), "__id": F.coalesce("__id", F.lit(0))}  # without nulls, for the join
    on = [*keys, "__mark"]
    placed = _components(docs, size, percent, id_col, text_col)
    placed = placed.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "root").withColumns(keys)
    firsts = placed.filter("root is not null").groupBy("root").agg(F.min(F.struct(*on)).alias("first"))
    kept = firsts.select("first.*", F.lit(True).alias("__once"))
    kept = kept.unionByName(placed.filter("root is null").select(*on).distinct().withColumn("__once", F.lit(False)))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__mark": F.xxhash64(F.col(text_col).cast("string"))}).withColumns(keys)
    nth = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    return keyed.join(kept, on).withColumn("__nth", nth).filter("not __once or __nth = 1").drop(*on, "__once", "__nth")
