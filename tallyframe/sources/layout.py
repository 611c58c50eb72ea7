"""Stored relations with declared schemas, bucketed and sorted by slot (S1): joins and aggregates by slot read them without a shuffle.

Relations that are joined have the same number of buckets. A bucket is one file and is read by one task, so the layout is
for keys that each have few rows, as a slot has: a bucket of a hot key could not be split. ``buckets_for`` sizes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BYTES = 256 * 1024 * 1024


def buckets_for(largest_bytes: int, cores: int = 1) -> int:
    """Buckets for the largest of the joined relations: about 256 MB each, and one a core at least."""
    return max(cores, 1, -(-largest_bytes // BUCKET_BYTES))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` as ``schema`` declares it: its columns in order, cast by ANSI rules; a missing column is an error, others go, and a null
    where none may be fails the query."""
    def column(f: T.StructField):
        c = F.col(f.name).cast(f.dataType)
        return c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"a null {f.name}")).cast(f.dataType))

    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*(column(f).alias(f.name) for f in schema))


def _name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, path: str, schema: T.StructType, buckets: int, key: str = "slot") -> DataFrame:
    """Writes ``df`` under ``path``, which must be new, and returns the stored relation.

    Rows are dealt by the buckets' own hash first, so that each bucket is one file, written by one task."""
    name = _name("stored")
    rows = conform(df, schema).repartition(buckets, key).sortWithinPartitions(key)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def opened(spark: SparkSession, path: str, schema: T.StructType, buckets: int, key: str = "slot") -> DataFrame:
    """A relation that ``store`` wrote, perhaps in another session, with the schema and buckets it was written with; no file is read for its schema."""
    name = _name("opened")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)
