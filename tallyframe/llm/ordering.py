"""Rows in a total order that no single task sorts: range partitions, and places from per-partition counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import written

#: The row number of ``in_order``: the partition's number in the upper bits, the row's number in it in the lower 33.
ROW = "__row"
ROW_BITS = 33


def in_order(spark: SparkSession, df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` stored with ``ROW``, a number that ascends along ``order`` (nulls first, texts bytewise).

    A hot value of the first columns is split by the later ones. Rows that are equal in all of
    ``order`` may take each other's numbers, so they have to be equal in the other columns as well.
    """
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return written(spark, ranged.withColumn(ROW, F.monotonically_increasing_id()), name)


def with_places(spark: SparkSession, rows: DataFrame, key: str, place: str, total: str) -> DataFrame:
    """``place`` (from 0) of each row of ``in_order`` among those of equal ``key`` (not null), and their number ``total``.

    ``key`` is the first column of the order, so its rows are consecutive; a window holds one row a
    partition of the key, however many rows these have."""
    part = F.shiftright(ROW, ROW_BITS)
    counted = rows.groupBy(key, part.alias("__part")).agg(F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n"))
    each = Window.partitionBy(key)
    before = F.sum("__n").over(each.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(spark, counted.select(key, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(each).alias(total)), "offsets")
    return (rows.withColumn("__part", part).join(offsets, [key, "__part"])
            .withColumn(place, F.col(ROW) + F.col("__shift")).drop("__part", "__shift"))
