"""The front of rows on any number of minimised columns, in tasks of bounded size.

Points are placed in the cells of a grid cut at quantiles.  A cell whose least corner is beaten by another
cell's greatest corner goes whole.  Of the others, a cell can only lose points to cells whose least corner
reaches below its greatest one; those meet block by block, each pair of blocks in a task of its own, so that
no task sees the whole front even where nothing is beaten.

Only cuts, and a row for each occupied cell of at most MOST_CELLS, come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.storage import materialize

#: Cells of a grid at most; points of a block; columns that the grid cuts at most.
MOST_CELLS, BLOCK, CUT_COLUMNS = 4096, 4096, 12
#: Points that are compared at once inside a task.
AT_ONCE = 256


def beaten(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which of ``rows`` a row of ``by`` beats: nowhere greater and somewhere less."""
    out = np.zeros(len(rows), dtype=bool)
    for i in range(0, len(rows), AT_ONCE):
        some = rows[i : i + AT_ONCE, None]
        for j in range(0, len(by), AT_ONCE):
            block = by[None, j : j + AT_ONCE]
            out[i : i + AT_ONCE] |= ((block <= some).all(axis=2) & (block < some).any(axis=2)).any(axis=1)
    return out


def front(points: np.ndarray) -> np.ndarray:
    """Which of distinct rows no other row beats; what beats a row comes before it in order of the columns."""
    good, order = np.zeros(len(points), dtype=bool), np.lexsort(points.T[::-1])
    kept = np.zeros((0, points.shape[1]))
    for at in range(0, len(order), AT_ONCE):
        some = order[at : at + AT_ONCE]
        some = some[~beaten(points[some], kept)]
        some = some[~beaten(points[some], points[some])]
        good[some] = True
        kept = np.concatenate([kept, points[some]])
    return good


def living_cells(least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """Which cells, given their corners, no other cell beats whole."""
    return ~beaten(least, greatest)


def reaching_pairs(least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (a, b), a cell with itself included, where a point of a might beat one of b."""
    found = [(least[None] <= greatest[i : i + AT_ONCE, None]).all(axis=2) for i in range(0, len(least), AT_ONCE)]
    b, a = np.nonzero(np.concatenate(found)) if found else (np.zeros(0, np.int64),) * 2
    return a, b


def _own_front(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points that no other one of their batch beats: no shuffle, memory of a batch."""

    def keep(batches):
        for batch in batches:
            batch = batch.drop_duplicates()
            yield batch[front(batch[keys].to_numpy())]

    return points.mapInPandas(keep, points.schema)


def _placed(points: DataFrame, keys: list[str], total: int, block: int) -> DataFrame:
    """``points`` with ``cell``: where they lie among quantiles, in about one cell for each ``block`` points."""
    cut = keys[:CUT_COLUMNS]
    side = int(max(1, min(MOST_CELLS, -(-total // block))) ** (1 / len(cut)) + 1e-9)
    cell = F.lit(0)
    if side > 1:
        for key, cuts in zip(cut, points.approxQuantile(cut, [i / side for i in range(1, side)], 0.01)):
            cell = cell * side + sum(((F.col(key) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))
    return points.withColumn("cell", cell)


def meetings(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of blocks that must meet, as rows ``a, block_a, b, block_b, own``: own ones are those of b.

    ``pairs(a, b, blocks_a, blocks_b)``; ``placed(cell, block, ...)``.
    """
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    givers = placed.withColumnsRenamed({"cell": "a", "block": "block_a"}).join(pairs, "a").withColumns({"block_b": blocks("blocks_b"), "own": F.lit(False)})
    takers = placed.withColumnsRenamed({"cell": "b", "block": "block_b"}).join(pairs, "b").withColumns({"block_a": blocks("blocks_a"), "own": F.lit(True)})
    return givers.unionByName(takers).drop("blocks_a", "blocks_b")


MEETING = ["a", "block_a", "b", "block_b"]


def _front_points(points: DataFrame, keys: list[str], block: int) -> DataFrame:
    spark, kinds = points.sparkSession, ", ".join(f"{k} double" for k in keys)
    points = materialize(_own_front(points, keys).distinct(), "front-points")
    placed = materialize(_placed(points, keys, points.count(), block), "front-cells")
    ends = [f(k).alias(f"{name}_{k}") for name, f in (("least", F.min), ("greatest", F.max)) for k in keys]
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()  # at most MOST_CELLS rows
    least, greatest = (cells[[f"{name}_{k}" for k in keys]].to_numpy() for name in ("least", "greatest"))
    alive = living_cells(least, greatest)
    cells, least, greatest = cells[alive], least[alive], greatest[alive]
    number, blocks = cells["cell"].to_numpy(np.int64), -(-cells["n"].to_numpy(np.int64) // block)

    def table(columns: dict, schema: str) -> DataFrame:
        return spark.createDataFrame(pd.DataFrame(columns), schema)

    living = F.broadcast(table({"cell": number, "blocks": blocks}, "cell int, blocks int"))
    placed = placed.join(living, "cell").withColumn("block", F.pmod(F.xxhash64(*keys), "blocks").cast("int")).drop("blocks")

    def alone(group: pd.DataFrame) -> pd.DataFrame:
        return group[front(group[keys].to_numpy())]

    placed = materialize(placed.groupBy("cell", "block").applyInPandas(alone, placed.schema), "front-blocks")
    a, b = reaching_pairs(least, greatest)
    pairs = table({"a": number[a], "b": number[b], "blocks_a": blocks[a], "blocks_b": blocks[b]}, "a int, b int, blocks_a int, blocks_b int")

    def lost(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"].to_numpy()
        rows = group[keys].to_numpy()
        return group.loc[own, keys][beaten(rows[own], rows[~own])]

    # A block has met itself already.
    met = meetings(placed, pairs).filter("a <> b or block_a <> block_b")
    return placed.select(*keys).join(met.groupBy(*MEETING).applyInPandas(lost, kinds).distinct(), keys, "left_anti")


def pareto_front_nd(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """Rows that no row beats on the minimised ``columns``, compared as doubles.

    Rows with a null or NaN among them leave, ties stay, repeated rows stay together; an empty table gives none.
    """
    keys = [f"__front_{i}" for i in range(len(columns))]
    rows = df.dropna(subset=columns).withColumns({k: F.col(c).cast("double") + F.lit(0.0) for k, c in zip(keys, columns)})
    return rows.join(_front_points(rows.select(*keys), keys, block), keys, "left_semi").select(*df.columns)
