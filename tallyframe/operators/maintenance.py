"""Sinks and table maintenance: upsert, insert-absent, counters, deletes, export.

Parquet tables have no MERGE, so maintenance is set-based: union the batch
with the target, pick the winner per key with a partial aggregate (max_by /
min_by on the ingest sequence; duplicates of one key never gather in one task
beyond the map-side combine), and write the result to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _pick(df: DataFrame, keys: list[str], seq: str, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    agg = F.max_by if last else F.min_by
    return (df.groupBy(*keys).agg(agg(F.struct(*rest), F.col(seq)).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def upsert(target: DataFrame, batch: DataFrame, keys, seq: str = "ingest_seq") -> DataFrame:
    """K1: last write replaces the whole row. Any batch row is newer than the target's row of its key;
    within the batch the highest ``seq`` wins. Only the batch is aggregated; the target is anti-joined."""
    k = _keys(keys)
    newest = _pick(batch, k, seq, last=True)
    return target.join(newest.select(*k), k, "left_anti").unionByName(newest.select(*target.columns))


def seed_if_empty(target: DataFrame, seed: DataFrame) -> DataFrame:
    """K9: the target, or the seed rows when the target has none."""
    rows = target.limit(1).select(F.count(F.lit(1))).scalar()
    return target.unionByName(seed.select(*target.columns).where(rows == 0))


def insert_absent(target: DataFrame, batch: DataFrame, keys, seq: str = "ingest_seq") -> DataFrame:
    """K2: first write wins. Batch rows are deduplicated (lowest ``seq``) and only
    keys absent from the target are appended. Returns the whole resulting table."""
    k = _keys(keys)
    fresh = _pick(batch, k, seq, last=False).join(target.select(*k), k, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def registry_counters(registry: DataFrame, activities: DataFrame, key: str = "address",
                      act_key: str = "wallet_address", ts: str = "ts") -> DataFrame:
    """K4: last_activity = latest activity time, activity_count = number of activities (0 if none)."""
    per = (activities.groupBy(F.col(act_key).alias(key))
           .agg(F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("activity_count")))
    return (registry.join(per, key, "left")
            .withColumn("activity_count", F.coalesce("activity_count", F.lit(0).cast("long"))))


def registry_remove(registry: DataFrame, requests: DataFrame, ident: str = "identifier") -> DataFrame:
    """K5: registry rows whose address or name is requested are removed. Returns the
    removed addresses; apply with ``left_anti`` on the registry and its activities."""
    req = requests.select(F.col(ident).alias("_i")).distinct()
    by_addr = registry.join(req, registry["address"] == req["_i"], "left_semi")
    by_name = registry.join(req, registry["name"] == req["_i"], "left_semi")
    return by_addr.select("address").union(by_name.select("address")).distinct()


def remove_keys(df: DataFrame, removed: DataFrame, key: str, removed_key: str = "address") -> DataFrame:
    return df.join(removed.select(F.col(removed_key).alias(key)), key, "left_anti")


def prometheus_lines(df: DataFrame, name: str, value: str, labels: Sequence[str] = ()) -> DataFrame:
    """K7: exposition lines ``name{l1="v1",...} value`` with a fixed 6-decimal value."""
    if labels:
        parts = [F.concat(F.lit(f'{lab}="'), F.coalesce(F.col(lab).cast("string"), F.lit("")), F.lit('"'))
                 for lab in labels]
        head = F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        head = F.lit(name)
    return df.select(F.concat(head, F.lit(" "), F.format_string("%.6f", F.col(value).cast("double")))
                     .alias("line"))


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = (),
                fmt: str = "parquet", compression: str | None = None) -> str:
    """K1-K3 sink: a set-based write; never overwrite a path the same plan reads."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    w.save(path)
    return path

