"""Windows and sequences: change detection, slot progress, gaps, leader changes.

All sequences of unbounded length go through ``operators.sequence``, so a hot key is split into
bounded (key, chunk) window groups; global sequences (no natural key) are chunked the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expr import unix_micros_ntz
from tallyframe.schemas import ACCOUNT_CHANGE_KINDS
from tallyframe.operators.sequence import ROWS_PER_CHUNK, with_ordinal, with_previous, with_running_mean

NUMBER_FIELDS = ("lamports", "data_size", "rent_epoch")
STATE_FIELDS = tuple(field for _, _, field, _ in ACCOUNT_CHANGE_KINDS)


def _change(kind: str, change: str, old: Column, new: Column, changed: Column,
            d_lamports: Column, d_data: Column, numbers: tuple[Column, Column]) -> Column:
    return F.struct(F.lit(kind).alias("activity_type"), F.lit(change).alias("change_type"),
                    old.alias("old_value"), new.alias("new_value"),
                    d_lamports.cast("long").alias("lamports_change"), d_data.cast("long").alias("data_size_change"),
                    numbers[0].cast("long").alias("old_number"), numbers[1].cast("long").alias("new_number"),
                    changed.alias("_changed"))


def account_changes(snapshots: DataFrame, key: str = "account_address", order: Sequence[str] = ("slot", "ts", "id"),
                    rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Compare each account state with the previous one of the same account.

    Emits 0-5 rows per state, in field order balance, data size, owner,
    executable, rent epoch; the first state of an account emits nothing.
    Output: account, block_slot, timestamp, snapshot_id, activity_type,
    change_type, old_value, new_value (texts), lamports_change, data_size_change,
    old_number, new_number (of number fields; else null),
    transaction_signature (``account_change_{addr}_{slot}_{epoch seconds}``).
    """
    d = with_previous(snapshots, [key], list(order), STATE_FIELDS, out="_p", rows=rows)
    p, c = F.col("_p"), F.col

    def differs(f):
        return ~c(f).eqNullSafe(p[f])

    zero, none = F.lit(0), F.lit(None)
    deltas = {"lamports": (c("lamports") - p["lamports"], zero), "data_size": (zero, c("data_size") - p["data_size"])}
    changes = F.array(*[
        _change(kind, change,
                F.concat(p[field].cast("string"), F.lit(suffix)) if suffix else p[field].cast("string"),
                F.concat(c(field).cast("string"), F.lit(suffix)) if suffix else c(field).cast("string"),
                differs(field), *deltas.get(field, (zero, zero)), (p[field], c(field)) if field in NUMBER_FIELDS else (none, none))
        for kind, change, field, suffix in ACCOUNT_CHANGE_KINDS])
    out = (d.where(p.isNotNull())
           .select(c(key).alias("account_address"), c("slot").alias("block_slot"), c("ts").alias("timestamp"),
                   c("id").alias("snapshot_id"),
                   F.inline(F.filter(changes, lambda x: x["_changed"])))
           .drop("_changed"))
    sig = F.concat_ws("_", F.lit("account_change"), F.col("account_address"), F.col("block_slot").cast("string"),
                      F.floor(unix_micros_ntz("timestamp") / 1000000).cast("long").cast("string"))
    return out.withColumn("transaction_signature", sig)


def distinct_until_changed(df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str] = (),
                           rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Drop rows whose value equals the previous row's; the first row is always kept."""
    d = with_previous(df, list(partition), list(order), [value], out="_p", rows=rows)
    return d.where(F.col("_p").isNull() | ~F.col(value).eqNullSafe(F.col("_p")[value])).drop("_p")


def slot_progress(reports: DataFrame, source: str = "source", order: Sequence[str] = ("observed_ts", "seq"),
                  rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per source, slot and finalized-slot deltas against the previous report.

    The first report of a source has delta 1; only increasing reports are emitted.
    """
    d = with_previous(reports, [source], list(order), ["slot", "finalized_slot"], out="_p", rows=rows)
    first = F.col("_p").isNull()
    d = d.select(*reports.columns,
                 F.when(first, F.lit(1)).otherwise(F.col("slot") - F.col("_p")["slot"]).cast("long")
                 .alias("slot_delta"),
                 F.when(first, F.lit(1)).otherwise(F.col("finalized_slot") - F.col("_p")["finalized_slot"])
                 .cast("long").alias("finalized_delta"))
    return d.where(F.col("slot_delta") > 0)


def leader_changes(leaders: DataFrame) -> DataFrame:
    """Leader schedule rows where the leader differs from the previous slot's.

    The first slot counts as a change with no previous leader.
    """
    d = with_previous(leaders, [], ["slot"], ["leader_pubkey"], out="_p")
    prev = F.col("_p")["leader_pubkey"]
    return (d.where(prev.isNull() | (prev != F.col("leader_pubkey")))
            .select("slot", "leader_pubkey", prev.alias("previous_leader")))


def leader_conflicts(reports: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """For each slot, reports whose leader differs from the previous report for the same slot.

    A slot has a report per reporting node, so its window group is small by nature."""
    d = reports.withColumn("previous_leader", F.lag("leader_pubkey").over(Window.partitionBy("slot").orderBy(*order)))
    return d.where(F.col("previous_leader") != F.col("leader_pubkey"))


def retain_recent(df: DataFrame, tip, keep: int = 100, slot: str = "slot") -> DataFrame:
    """Keep entries with slot >= tip - keep (floored at 0)."""
    return df.where(F.col(slot) >= F.greatest(tip - F.lit(keep), F.lit(0)))


def tx_ordinal(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """1-based message ordinal per key (no global ordinal: that is one task)."""
    return with_ordinal(df, [key], list(order), out="ordinal")


def running_latency(log: DataFrame, by: Sequence[str] = ("kind",), order: Sequence[str] = ("ts", "request_id"),
                    value: str = "response_us") -> DataFrame:
    """Running mean response per endpoint."""
    return with_running_mean(log, list(by), list(order), value, out="running_mean")


def slot_gaps(headers: DataFrame, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Missed slots and reorgs along landed headers ordered by slot.

    gap = slot - previous slot - 1; reorg when parent_slot < previous slot,
    depth = previous slot - parent_slot. Only rows with a gap or reorg.
    """
    d = with_previous(headers, [], ["slot"], ["slot"], out="_p", rows=rows)
    prev = F.col("_p")["slot"]
    d = d.select("slot", "parent_slot", prev.alias("previous_slot"),
                 (F.col("slot") - prev - 1).alias("missed_slots"),
                 (F.col("parent_slot") < prev).alias("reorg"),
                 F.when(F.col("parent_slot") < prev, prev - F.col("parent_slot")).otherwise(F.lit(0))
                 .cast("long").alias("reorg_depth"))
    return d.where(prev.isNotNull() & ((F.col("missed_slots") > 0) | F.col("reorg")))
