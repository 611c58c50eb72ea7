"""Table sources: parquet scans of the stored relations and the driver fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FIXTURE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                  "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan a stored relation. A declared schema skips inference and lets
    the scan prune columns and push filters into the parquet reader."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


class Tables:
    """Lazy accessor for the fixture tables of one scale-factor folder, as tables or as file streams."""

    def __init__(self, spark: SparkSession, sf_dir: str, streaming: bool = False):
        self.spark = spark
        self.streaming = streaming
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FIXTURE_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            path = f"{self.sf_dir}/{name}.parquet"
            table = read_table(self.spark, path)
            # as a pattern, so that the file source takes a table of one file as well as a folder
            self._cache[name] = self.spark.readStream.schema(table.schema).parquet(f"{path[:-1]}[t]") if self.streaming else table
        return self._cache[name]
