"""Global order as data: a rank column without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import written

#: monotonically_increasing_id holds the partition above this many bits, the row below.
ROW_BITS = 33


#: ranked_top numbers at most so many rows in one task.
TOP_ROWS = 10_000


def _laid(df: DataFrame, *order: Column) -> DataFrame:
    """df in sorted ranges, written once, with _at: number of the range and place in it."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")


def _before(laid: DataFrame, amount: Column, first: int) -> Column:
    """first plus the amounts of all ranges before a row's own; there are as many ranges as partitions."""
    part = F.shiftright("_at", ROW_BITS)
    sizes = sorted((r["part"], r["n"]) for r in laid.groupBy(part.alias("part")).agg(amount.alias("n")).collect())
    starts, total = [], first
    for number, n in sizes:
        starts += [F.lit(number).cast("bigint"), F.lit(total).cast("bigint")]
        total += n or 0
    return F.element_at(F.create_map(*starts), part) if starts else F.lit(first)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its 1-based place in the order: the place in a sorted range plus the sizes of those before."""
    laid = _laid(df, *order)
    start = _before(laid, F.count(F.lit(1)), 1)
    return laid.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).cast("bigint")).drop("_at")


def running_total(df: DataFrame, value: str, *order: Column, name: str = "total") -> DataFrame:
    """df with the sum of a BIGINT column up to and with each row, in the order.

    Each sorted range is summed in a task of its own; ranges are cut by rows, so no value of the order
    gathers more rows in a task than a range holds. Rows equal in the whole order must not exist.
    """
    laid = _laid(df, *order)
    start = _before(laid, F.sum(value), 0)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn("_part", F.shiftright("_at", ROW_BITS)).withColumn(name, (start + F.sum(value).over(inside)).cast("bigint")).drop("_at", "_part")


def ranked_top(df: DataFrame, limit: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first rows of the order with their places; a bounded set needs one window only."""
    if limit > TOP_ROWS:
        return ranked(df, *order, name=name).filter(F.col(name) <= limit)
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def numbered(df: DataFrame, group: str, *order: Column, name: str = "n") -> DataFrame:
    """df with each row's 1-based place among those of its group: a place in sorted ranges less the group's first.

    A group that holds most of the rows is many ranges, where a window over it would be one task.
    """
    placed = ranked(df, F.col(group), *order, name="_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return placed.join(first, group).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
