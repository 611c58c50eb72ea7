"""A stored table kept up to date by ranges of its key: a batch rewrites the ranges it touches.

Layout under ``path``:

* ``rows/batch=N/range=R``: the whole range R as batch N left it;
* ``versions/batch=N``: for every range, the batch that wrote it last. Its success marker publishes batch N.

Readers take the newest published version and open the files of its ranges alone, so they see a batch whole or not at
all, whatever is lost while it is written. A batch that runs again starts from the versions before it, overwrites
its own folders, and gives the same table. One row a range passes through the driver, as many as there are
folders to list; a range holds ``width`` consecutive keys, so choose ``width`` for files of some hundred MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.maintenance import upsert

RANGE = "range"
VERSIONS = T.StructType([T.StructField(RANGE, T.LongType()), T.StructField("batch", T.LongType())])


class RangeTable:
    """A table of ``schema`` with one row per ``key`` (a long; a null key fails the batch), in ranges of ``width`` keys.

    One writer at a time, with rising batch ids. ``schema`` must have no column called ``range``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "slot", width: int = 1_000_000):
        if RANGE in schema.names:
            raise ValueError(f"the column name {RANGE} is taken by the layout")
        self.spark, self.path, self.schema, self.key, self.width = spark, path.rstrip("/"), schema, key, width

    def _range(self) -> Column:
        key = F.col(self.key)
        return F.when(key.isNull(), F.raise_error(F.lit(f"a null {self.key} has no range"))).otherwise(F.floor(key / F.lit(self.width))).cast("long")

    def _files(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Ids of the published batches, oldest first."""
        path, fs = self._files("versions")
        if not fs.exists(path):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix("batch=")) for n in found
                      if n.startswith("batch=") and fs.exists(self._files("versions", n, "_SUCCESS")[0]))

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Range -> the batch that holds it, as published (by batches under ``before``)."""
        ids = [b for b in self.batches() if before is None or b < before]
        if not ids:
            return {}
        rows = self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions/batch={ids[-1]}")
        return {r[RANGE]: r["batch"] for r in rows.collect()}

    def _load(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/batch={b}/{RANGE}={r}" for r, b in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, low: int | None = None, high: int | None = None) -> DataFrame:
        """The table, or its keys low..high; only files of ranges that meet those are opened."""
        keep = {r: b for r, b in self.versions().items()
                if (low is None or (r + 1) * self.width > low) and (high is None or r * self.width <= high)}
        rows = self._load(keep)
        if low is not None:
            rows = rows.where(F.col(self.key) >= low)
        return rows if high is None else rows.where(F.col(self.key) <= high)

    def upsert(self, batch: DataFrame, batch_id: int, seq: str = "ingest_seq") -> list[int]:
        """K1: batch rows replace the table's rows of their keys, the highest ``seq`` winning within the batch. Returns
        the ranges rewritten. The batch is read twice: for its ranges, and for its rows."""
        if any(b > batch_id for b in self.batches()):
            raise ValueError(f"batch {batch_id} comes after a later one")
        held = self.versions(before=batch_id)
        touched = sorted(r[RANGE] for r in batch.select(self._range().alias(RANGE)).distinct().collect())
        if touched:
            old = self._load({r: held[r] for r in touched if r in held})
            rows = upsert(old, batch, self.key, seq).withColumn(RANGE, self._range())
            # by the key, so that a crowded range is written by several tasks and a task writes few ranges
            (rows.repartitionByRange(RANGE, self.key).sortWithinPartitions(RANGE, self.key)
             .write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.path}/rows/batch={batch_id}"))
        now = sorted({**held, **dict.fromkeys(touched, batch_id)}.items())
        self.spark.createDataFrame(now, VERSIONS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch_id}")
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Removes versions but the ``keep`` newest, and the range folders that none of those names; returns how many folders went."""
        ids = self.batches()
        kept = ids[-keep:] if keep > 0 else ids[-1:]
        used = {(b, r) for i in kept for r, b in self.versions(before=i + 1).items()}
        gone = 0
        for i in ids:
            if i not in kept:
                path, fs = self._files("versions", f"batch={i}")
                fs.delete(path, True)
        for i in ids:
            path, fs = self._files("rows", f"batch={i}")
            for status in fs.listStatus(path) if fs.exists(path) else []:
                name = status.getPath().getName()
                if name.startswith(f"{RANGE}=") and (i, int(name.removeprefix(f"{RANGE}="))) not in used:
                    gone += bool(fs.delete(status.getPath(), True))
        return gone
