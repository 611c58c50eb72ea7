"""Session construction and the shared folder for lineage cuts and stream state."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (fixture timestamps are UTC),
# AQE for runtime re-planning (coalescing, skew-join splitting, broadcast
# conversion from measured sizes), and a bounded auto-broadcast threshold so a
# dimension side is only broadcast when its measured size is small.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Shuffle and scan sizing for an input volume, so partitions fit executor memory.

    Shuffle partitions start at input / 256 MiB (at least 2 per core); AQE then
    coalesces small ones toward the 128 MiB advisory size and splits skewed ones
    above 512 MiB. Scans split files at 256 MiB. At 100 TB on 1000 executors x 8
    cores this gives ~400k initial shuffle partitions, coalesced at runtime.
    """
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tallyframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _private_dir(master: str) -> str:
    """A folder of this machine, for sessions whose tasks all run on it."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and tasks of master {master} do not share this machine's folders: "
                           "set it to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tallyframe-ckpt-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, a private folder is made for a local master, as in
    tests; on any other master that is an error, since each executor would write to its own disk.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect)
        sc = None
    if sc is None:
        return spark.conf.get("spark.checkpoint.dir", None) or _private_dir(spark.conf.get("spark.master", ""))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or _private_dir(sc.master))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``tallyframe`` importable in executor Python workers (``addPyFile``).

    Plans that carry Python code (Arrow UDFs, stateful stream functions) reference
    this package by module; executors have it only if it is installed there or
    shipped. The zip is built once per application from the driver's copy and
    served to executors by Spark."""
    import shutil

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: ship with the session's artifact API instead
        return
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tallyframe-pkg-"), "tallyframe"), "zip",
                                  root_dir=root, base_dir="tallyframe")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-path of the shared folder; never reused, and removed only where a ``scratch_scope`` ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at its end: for work whose results are written before that, such as a micro-batch."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

