"""Rows numbered in a global order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladewise.plans.storage import written

#: A row's number within its partition has so many bits below the partition's own.
BITS = 33


def _parts(rows: DataFrame, order: list[Column | str], size: Column) -> tuple[DataFrame, DataFrame]:
    """The rows sorted by ranges and written, each with its partition and place there; and what the partitions before each add up to."""
    table = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted").df
    sizes = table.groupBy(F.shiftright("_at", BITS).alias("_part")).agg(size.alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("_part", F.shiftright("_at", BITS)), F.broadcast(sizes.select("_part", before.alias("_before")))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, counted from 1 in an order (ties as they come).

    Rows are sorted by ranges and written; a row's number is its place in its
    partition and the sizes of the partitions before it, of which there is one
    row each.
    """
    table, offsets = _parts(rows, order, F.count("*"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    return table.join(offsets, "_part").select(*rows.columns, place.cast("long").alias(name))


def running(rows: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before, in an order; within a range by a window, and the sums of the ranges before it."""
    table, offsets = _parts(rows, order, F.sum(value))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.withColumn("_own", own).join(offsets, "_part").select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
