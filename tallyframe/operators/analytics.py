"""Declared-only user features: analytics windows, alerts, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expr import to_coin
from tallyframe.operators.ledger import latest_per_key


def _since(df: DataFrame, asof, days: int, ts: str) -> DataFrame:
    lo = F.lit(asof).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= F.lit(asof).cast("timestamp_ntz")))


def wallet_analytics(activities: DataFrame, asof: str, days: int = 30, key: str = "wallet_address",
                     ts: str = "ts") -> DataFrame:
    """Per (wallet, activity_type) over [asof - days, asof]: count, fee sum, first/last time, active days."""
    d = _since(activities, asof, days, ts)
    return d.groupBy(key, "activity_type").agg(
        F.count(F.lit(1)).alias("n_activities"), F.sum("fee").cast("long").alias("total_fees"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_distinct(F.to_date(ts)).alias("active_days"))


def activity_days(activities: DataFrame, key: str = "wallet_address", ts: str = "ts") -> DataFrame:
    """D1 rollup, to be stored: per (wallet, activity_type, day) count, fee sum, first and last time. Days of new batches
    are appended; a day that is rolled up again replaces its rows."""
    return activities.groupBy(key, "activity_type", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("n_activities"), F.sum("fee").cast("long").alias("total_fees"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def wallet_analytics_from_days(stored: DataFrame, activities: DataFrame, asof: str, days: int = 30, key: str = "wallet_address",
                               ts: str = "ts") -> DataFrame:
    """D1 as ``wallet_analytics`` gives it, for any as-of time: whole days from the stored rollup, the parts of days at the two
    ends from the log (a filter on time alone, which reaches the scan). Days of one (wallet, type) are distinct rows, so they count themselves."""
    end = F.lit(asof).cast("timestamp_ntz")
    low = end - F.make_interval(days=F.lit(days))
    first, last = F.to_date(low + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")), F.to_date(end)
    ends = _since(activities, asof, days, ts).where((F.col(ts) < first.cast("timestamp_ntz")) | (F.col(ts) >= last.cast("timestamp_ntz")))
    whole = stored.where((F.col("day") >= first) & (F.col("day") < last))
    parts = whole.unionByName(activity_days(ends, key, ts))
    return parts.groupBy(key, "activity_type").agg(
        F.sum("n_activities").alias("n_activities"), F.sum("total_fees").alias("total_fees"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"), F.count_distinct("day").alias("active_days"))


def account_analytics(changes: DataFrame, asof: str, days: int = 30, key: str = "account_address",
                      ts: str = "timestamp") -> DataFrame:
    """Per (account, activity_type): count, net and absolute lamports change, net data change."""
    d = _since(changes, asof, days, ts)
    return d.groupBy(key, "activity_type").agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.sum("lamports_change").cast("long").alias("net_lamports_change"),
        F.sum(F.abs("lamports_change")).cast("long").alias("abs_lamports_change"),
        F.sum("data_size_change").cast("long").alias("net_data_size_change"))


def changes_over_min(changes: DataFrame, min_coin: float) -> DataFrame:
    """Changes whose absolute lamports change is at least ``min_coin`` coins."""
    return changes.where(F.abs(to_coin("lamports_change")) >= F.lit(float(min_coin)))


def threshold_alerts(changes: DataFrame, registry: DataFrame, key: str = "account_address",
                     reg_key: str = "address") -> DataFrame:
    """Balance alert when a balance change crosses the account's threshold (in coins)
    in either direction; data alert when |data_size_change| >= the data threshold."""
    reg = registry.select(F.col(reg_key).alias(key), "balance_threshold", "data_size_threshold")
    d = changes.join(reg, key, "inner")
    new_c, old_c = to_coin("new_number"), to_coin("old_number")
    thr = F.col("balance_threshold")
    bal = (F.col("change_type") == "BALANCE") & thr.isNotNull() & (
        ((old_c < thr) & (new_c >= thr)) | ((old_c >= thr) & (new_c < thr)))
    data = (F.col("change_type") == "DATA_SIZE") & F.col("data_size_threshold").isNotNull() & (
        F.abs("data_size_change") >= F.col("data_size_threshold"))
    return (d.where(bal | data)
            .withColumn("alert", F.when(bal, F.when(new_c >= thr, "BALANCE_ABOVE").otherwise("BALANCE_BELOW"))
                        .otherwise("DATA_SIZE")))


def latest_balances(balances: DataFrame) -> DataFrame:
    """Latest balance per (wallet, token); a null mint is the native coin and is its own group."""
    return latest_per_key(balances, ["wallet_address", "token_mint"], ["ts", "slot", "id"])


def fresh_state(df: DataFrame, key: str, ts: str, ttl_seconds: int, now: str) -> DataFrame:
    """R5 (batch): the latest state per key, kept only if written within ``ttl_seconds`` of ``now``."""
    lo = F.lit(now).cast("timestamp_ntz") - F.make_interval(secs=F.lit(ttl_seconds))
    # The time is the first ordering column, so dropping older rows first leaves the same latest
    # ones and the filter reaches the scan.
    return latest_per_key(df.where(F.col(ts) >= lo), key, [ts, "id"] if "id" in df.columns else [ts])
