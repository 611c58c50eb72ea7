"""Joins. All equi-joins; Catalyst and AQE pick the strategy.

No side is broadcast by hint: Spark broadcasts a side whose estimated or measured bytes are under
its threshold, and splits skewed partitions of the shuffle joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.schemas import SYSTEM_PROGRAM

def watched_states(states: DataFrame, registry: DataFrame, key: str = "account_address",
                   reg_key: str = "address", active_only: bool = True) -> DataFrame:
    """Account states of watched addresses with the registry's name and tag."""
    reg = registry.where(F.col("is_active")) if active_only else registry
    reg = reg.select(F.col(reg_key).alias(key), F.col("name"), F.col("tag"))
    return states.join(reg, key, "inner")


def multi_get(requests: DataFrame, hot: DataFrame, store: DataFrame, key: str, limit: int = 0) -> DataFrame:
    """Resolve requested keys from the hot source first, then the store.

    Unresolved keys are dropped; a key found in both comes from the hot source.
    ``source`` tells which; ``limit`` > 0 keeps the first ``limit`` keys in key order.
    """
    req = requests.select(key).distinct()
    cols = [c for c in store.columns]
    tagged = (hot.select(*cols).withColumn("_prio", F.lit(0))
              .unionByName(store.select(*cols).withColumn("_prio", F.lit(1))))
    found = tagged.join(req, key, "left_semi")
    rest = [c for c in cols if c != key]
    best = (found.groupBy(key).agg(F.min_by(F.struct(*rest, "_prio"), F.col("_prio")).alias("_r"))
            .select(key, *[F.col("_r")[c].alias(c) for c in rest],
                    F.when(F.col("_r")["_prio"] == 0, "hot").otherwise("store").alias("source")))
    if limit and limit > 0:
        best = best.orderBy(key).limit(limit)
    return best


def cached_count(resolved: DataFrame) -> DataFrame:
    """Number of keys served from the hot source, and the total."""
    return resolved.agg(F.count_if(F.col("source") == "hot").alias("cached_count"),
                        F.count(F.lit(1)).alias("total_count"))


def fk_orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child key values with no parent row, with the number of child rows."""
    pk = parent_key or key
    orphans = child.join(parent.select(F.col(pk).alias(key)), key, "left_anti")
    return orphans.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def tx_enriched(tx: DataFrame, slots: DataFrame, leaders: DataFrame) -> DataFrame:
    """Transaction -> slot header -> slot leader, left joins on slot."""
    return (tx.join(slots.select("slot", "blockhash", F.col("ts").alias("block_ts")), "slot", "left")
            .join(leaders.select("slot", "leader_pubkey"), "slot", "left"))


def best_label(labels: DataFrame, key: str = "address") -> DataFrame:
    """The highest-confidence label per address (lowest id on ties), as a partial aggregate."""
    rest = ["label", "label_type", "confidence", "id"]
    return (labels.groupBy(key)
            .agg(F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("id"))).alias("_b"))
            .select(key, *[F.col("_b")[c].alias(c) for c in rest[:-1]]))


def label_enrich(df: DataFrame, labels: DataFrame, key: str, label_key: str = "address") -> DataFrame:
    b = best_label(labels, label_key).withColumnRenamed(label_key, key)
    return df.join(b, key, "left")


def get_account(requests: DataFrame, states: DataFrame, key: str = "address") -> DataFrame:
    """Requested accounts with their state, or a default row (system owner, zeros)."""
    req = requests.select(key).distinct()
    return (req.join(states, key, "left")
            .select(key,
                    F.coalesce("lamports", F.lit(0).cast("long")).alias("lamports"),
                    F.coalesce("owner", F.lit(SYSTEM_PROGRAM)).alias("owner"),
                    F.coalesce("executable", F.lit(False)).alias("executable"),
                    F.coalesce("rent_epoch", F.lit(0).cast("long")).alias("rent_epoch"),
                    F.coalesce("data_size", F.lit(0).cast("long")).alias("data_size"),
                    F.col("owner").isNotNull().alias("found")))


def tx_by_program(tx: DataFrame, programs, ids: str = "program_ids", key: str = "signature") -> DataFrame:
    """Transactions whose program list contains a requested program.

    A literal list is an ``arrays_overlap`` filter (no shuffle); a request
    table is joined: exploded to (signature, program) and semi-joined, so it may be large.
    """
    if isinstance(programs, (list, tuple)):
        return tx.where(F.arrays_overlap(F.col(ids), F.array(*[F.lit(p) for p in programs])))
    pairs = tx.select(key, F.explode(ids).alias("program_id"))
    hits = pairs.join(programs.select("program_id"), "program_id", "left_semi").select(key).distinct()
    return tx.join(hits, key, "left_semi")


def ensure_parents(child: DataFrame, parent: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Parent rows to create so every child key has a parent (placeholders from ``defaults``)."""
    missing = child.select(key).distinct().join(parent.select(key), key, "left_anti")
    return missing.select(key, *[F.lit(v).alias(k) for k, v in defaults.items()])
