"""Skew-safe sequence primitives: previous row, ordinal and running aggregates.

A plain ``Window.partitionBy(key)`` puts every row of one key into one task; one account, program
or request kind can hold a third of all rows, and they may all fall into one minute. Here the frame is
stored once in the order of (keys, ordering columns), by range partitions, and cut into chunks of at most
``ROWS_PER_CHUNK`` consecutive stored rows, whatever keys and times these have. Windows run within
chunks, so a window group is bounded by a row count, not by an assumption about the data: bursts,
outliers, equal times and hot keys are all cut alike, and small keys share a chunk.

What crosses a chunk's edge (the last row before it, or counts and sums of the key that goes on) is one
row a chunk. Of the few keys that go on over many chunks, these rows are cumulated; then each chunk looks at
the one before it, within its partition or, at a partition's start, by one row a partition.

The stored frame is what makes all readers agree on the chunks, also when an executor is lost; it lies in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

CHUNK, ROW = "_chunk", "_row"
ROWS_PER_CHUNK = 65_536
#: ``ROW`` is a partition's number in the upper bits and the place of the row in it in the lower ones.
PLACE_BITS = 33


def with_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """``df`` stored in the order of ``keys`` and ``order`` (nulls first), with ROW, and CHUNK, the ``rows`` consecutive rows it belongs to."""
    spark, by = df.sparkSession, [F.col(c) for c in (*keys, *order)]
    path = scratch_path(spark, "sequence")
    stored = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(ROW, F.monotonically_increasing_id())
    stored.write.parquet(path)
    place = F.col(ROW).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return spark.read.schema(stored.schema).parquet(path).withColumn(CHUNK, F.col(ROW) - place + F.floor(place / rows).cast("long"))


def _key(keys: Sequence[str]) -> Column:
    """All keys as one value, equal when all are equal or both null."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _from_chunk_before(summary: DataFrame, column: str, out: str) -> DataFrame:
    """(CHUNK, ``out``): ``column`` of the chunk before; ``summary`` has a row a chunk."""
    part = F.shiftright(CHUNK, PLACE_BITS).alias("_part")
    summary = summary.select(CHUNK, part, column)
    tops = summary.groupBy("_part").agg(F.max_by(column, CHUNK).alias("_top"))
    tops = tops.select("_part", F.lag("_top").over(Window.orderBy("_part")).alias("_top"))  # a row a partition
    near = F.lag(column).over(Window.partitionBy("_part").orderBy(CHUNK)).alias(out)
    return summary.select(CHUNK, "_part", near).join(tops, "_part", "left").select(CHUNK, F.coalesce(out, "_top").alias(out))


def _carried(d: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """(CHUNK, ``_edge``): for each chunk the key that the chunk before ends with, and the ``sums`` over all rows of that key up to there."""
    last = d.groupBy(CHUNK).agg(F.max_by(_key(keys), ROW).alias("_k"))
    ends = d.join(last, CHUNK).where(F.col("_k").eqNullSafe(_key(keys))).groupBy(CHUNK, "_k").agg(*(c.alias(n) for n, c in sums.items()))
    upto = Window.partitionBy("_k").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = ends.select(CHUNK, F.struct(F.col("_k").alias("k"), *(F.sum(n).over(upto).alias(n) for n in sums)).alias("_last"))
    return _from_chunk_before(total, "_last", "_edge")


def _goes_on(keys: Sequence[str]) -> Column:
    """Whether the key of a row is the one that the chunk before ends with."""
    return F.col("_edge.k").eqNullSafe(_key(keys))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                  out: str = "prev", rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add struct column ``out`` = values of the previous row of the same key.

    ``order`` must be a unique ascending ordering within a key. ``out`` is null on the first row of a key.
    """
    d = with_chunk(df, keys, order, rows)
    row = F.struct(_key(keys).alias("k"), F.struct(*values).alias("v"))
    edge = _from_chunk_before(d.groupBy(CHUNK).agg(F.max_by(row, ROW).alias("_last")), "_last", "_edge")
    d = d.withColumn("_before", F.lag(row).over(Window.partitionBy(CHUNK).orderBy(ROW)))
    d = d.join(edge, CHUNK, "left").withColumn("_before", F.coalesce("_before", "_edge"))
    return d.withColumn(out, F.when(F.col("_before.k").eqNullSafe(_key(keys)), F.col("_before.v"))).drop("_before", "_edge", CHUNK, ROW)


def _in_chunk(keys: Sequence[str]):
    return Window.partitionBy(CHUNK, *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "ordinal", rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """1-based position of each row within its key along ``order``."""
    d = with_chunk(df, keys, order, rows)
    edge = _carried(d, keys, {"n": F.count(F.lit(1))})
    before = F.when(_goes_on(keys), F.col("_edge.n")).otherwise(F.lit(0))
    d = d.withColumn("_n", F.row_number().over(_in_chunk(keys))).join(edge, CHUNK, "left")
    return d.withColumn(out, (F.col("_n") + before).cast("long")).drop("_n", "_edge", CHUNK, ROW)


def with_running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "running_mean",
                      rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Mean of ``value`` over all rows of the key up to and including this one; null while there is no value."""
    d = with_chunk(df, keys, order, rows)
    v = F.col(value).cast("double")
    edge = _carried(d, keys, {"s": F.coalesce(F.sum(v), F.lit(0.0)), "c": F.count(value)})
    d = d.withColumn("_s", F.sum(v).over(_in_chunk(keys))).withColumn("_c", F.count(value).over(_in_chunk(keys))).join(edge, CHUNK, "left")
    s, c = (F.coalesce(f"_{x}", F.lit(0)) + F.when(_goes_on(keys), F.col(f"_edge.{x}")).otherwise(F.lit(0)) for x in "sc")
    return d.withColumn(out, F.when(c > 0, s / c)).drop("_s", "_c", "_edge", CHUNK, ROW)


def with_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "running_total",
                       rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one; nulls count as 0."""
    d = with_chunk(df, keys, order, rows)
    edge = _carried(d, keys, {"s": F.coalesce(F.sum(value), F.lit(0))})
    before = F.when(_goes_on(keys), F.col("_edge.s")).otherwise(F.lit(0))
    d = d.withColumn("_s", F.sum(value).over(_in_chunk(keys))).join(edge, CHUNK, "left")
    return d.withColumn(out, F.coalesce("_s", F.lit(0)) + before).drop("_s", "_edge", CHUNK, ROW)
