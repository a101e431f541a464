"""Global row numbers and running values without a sort of a whole table or group in one task.

Rows are dealt over range partitions of the order, numbered inside each, and each partition starts where
the ones before it end.  Only counts per partition are summed along the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.storage import materialize


def number_rows(rows: DataFrame, order: list[Column | str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with ``name``: their place from 0 in ``order``, within each group of ``by`` if given.

    Give ``order`` a last column that tells ties apart, so that a hot value is spread over partitions too;
    ``by`` columns must not be null.  Without ``by`` the counts, one per partition, come to the driver.
    """
    by = by or []
    part, inside, before = f"__part_{name}", f"__in_{name}", f"__before_{name}"
    dealt = materialize(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*by, part).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        along = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(*by, part, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias(before))
    else:
        total, starts = 0, []
        for p, n in sorted(counts.collect()):  # a row per range partition
            starts.append((p, total))
            total += n
        starts = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{part} int, {before} long"))
    numbered = dealt.withColumn(inside, F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)))
    found = numbered.join(starts, [*by, part])
    return found.withColumn(name, F.col(before) + F.col(inside) - 1).select(*rows.columns, name)


def scan(rows: DataFrame, order: list[str], by: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` with running values along ``order`` in each group of ``by``, as many tasks to a group as it has ranges.

    ``wanted`` gives each new column a kind and what it is made of: ``sum`` up to and with the row, ``highest`` of
    the rows before it, ``last`` that is not null up to and with the row, or ``previous``, the value of the row before.
    Rows are dealt over range partitions of group and order; each range is folded on its own, what the
    ranges before it carry over is folded from one row a range and group, and the two are put together.
    ``order`` are ascending columns, the last of which tells ties apart.
    """
    made = materialize(rows.withColumns({f"__of_{name}": of for name, (_, of) in wanted.items()}).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "__part").orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    own, whole, carried, joined = {}, [], {}, {}
    for name, (kind, _) in wanted.items():
        of, mine, total, before = F.col(f"__of_{name}"), f"__own_{name}", f"__whole_{name}", f"__before_{name}"
        if kind == "sum":
            own[mine], fold, carry = F.sum(of).over(upto), F.sum(of), F.sum(total).over(along)
            joined[name] = F.coalesce(F.col(before), F.lit(0)) + F.coalesce(F.col(mine), F.lit(0))
        elif kind == "highest":
            own[mine], fold, carry = F.max(of).over(earlier), F.max(of), F.max(total).over(along)
            joined[name] = F.greatest(mine, before)
        elif kind == "last":
            own[mine], fold, carry = F.last(of, ignorenulls=True).over(upto), F.max_by(of, F.when(of.isNotNull(), place)), F.last(total, ignorenulls=True).over(along)
            joined[name] = F.coalesce(mine, before)
        elif kind == "previous":  # in a struct, so that a row with a null is told from no row
            own[mine], fold, carry = F.lag(F.struct(of.alias("v"))).over(inside), F.max_by(F.struct(of.alias("v")), place), F.last(total, ignorenulls=True).over(along)
            joined[name] = F.when(F.col(mine).isNotNull(), F.col(f"{mine}.v")).otherwise(F.col(f"{before}.v"))
        else:
            raise ValueError(kind)
        whole.append(fold.alias(total))
        carried[before] = carry
    keys = [*by, "__part"]
    ends = made.groupBy(*keys).agg(*whole).withColumns(carried).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *carried)
    both = made.withColumns(own).join(ends, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return both.withColumns(joined).select(*rows.columns, *wanted)
