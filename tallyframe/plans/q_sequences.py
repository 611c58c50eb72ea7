"""Registered queries: change detection, sequences, analytics over changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import analytics, changes, ledger
from tallyframe.operators.sequence import with_previous
from tallyframe.plans.registry import ASOF, oracle_text, query
from tallyframe.session import scratch_path

CHANGE_COLS = ["account_address", "block_slot", "timestamp", "snapshot_id", "activity_type", "change_type",
               "old_value", "new_value", "lamports_change", "data_size_change", "transaction_signature"]

def active(v):
    return v.tracked.where(F.col("is_active")).select(F.col("address").alias("account_address"))


def account_change_rows(v, only=None):
    """W1 over all snapshots, or over those of the accounts in ``only`` (an account's changes need its own states alone)."""
    snapshots = v.snapshots if only is None else v.snapshots.join(only, "account_address", "left_semi")
    return changes.account_changes(snapshots)


@query("account_changes", oracle_text("SELECT * FROM changes", "changes"))
def account_changes(v, spark, sf):
    """W1 (flagship): field-level changes between successive states of every account."""
    return account_change_rows(v).select(*CHANGE_COLS)


@query("owner_changes", oracle_text("""
SELECT owner, id, slot, old_value, new_value FROM (
  SELECT owner, id, slot, lamports, CAST(lag(lamports) OVER w AS VARCHAR) || ' lamports' AS old_value,
         CAST(lamports AS VARCHAR) || ' lamports' AS new_value, lag(lamports) OVER w AS p
  FROM v_snapshots WINDOW w AS (PARTITION BY owner ORDER BY slot, ts, id))
WHERE p IS DISTINCT FROM lamports AND old_value IS NOT NULL"""))
def owner_changes(v, spark, sf):
    """W1 on a skewed key: balance changes along the states of each owner (a handful of owners hold all rows)."""
    d = with_previous(v.snapshots, ["owner"], ["slot", "ts", "id"], ["lamports"], out="_p", rows=1024)
    text = [F.concat(c.cast("string"), F.lit(" lamports")) for c in (F.col("_p.lamports"), F.col("lamports"))]
    return (d.where(F.col("_p").isNotNull() & ~F.col("lamports").eqNullSafe(F.col("_p.lamports")))
            .select("owner", "id", "slot", text[0].alias("old_value"), text[1].alias("new_value")))


@query("account_history", oracle_text("""
SELECT account_address, block_slot, timestamp, snapshot_id, activity_type, change_type, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY account_address
                               ORDER BY timestamp DESC, snapshot_id DESC, activity_type) AS rank
  FROM changes WHERE account_address IN (SELECT address FROM v_tracked WHERE is_active))
WHERE rank <= 50""", "changes"))
def account_history(v, spark, sf):
    """Newest 50 change rows of every active watched account."""
    return ledger.top_k_per_key(account_change_rows(v, active(v)), "account_address", [F.col("timestamp").desc(), F.col("snapshot_id").desc(),
                                                        F.col("activity_type")], 50) \
        .select("account_address", "block_slot", "timestamp", "snapshot_id", "activity_type", "change_type", "rank")


@query("account_analytics", oracle_text(f"""
SELECT account_address, activity_type, count(*) AS n_changes,
       CAST(sum(lamports_change) AS BIGINT) AS net_lamports_change,
       CAST(sum(abs(lamports_change)) AS BIGINT) AS abs_lamports_change,
       CAST(sum(data_size_change) AS BIGINT) AS net_data_size_change
FROM changes WHERE timestamp >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY AND timestamp <= TIMESTAMP '{ASOF}'
GROUP BY account_address, activity_type""", "changes"))
def account_analytics(v, spark, sf):
    """Per (account, kind) change analytics over the 30 days before the as-of time."""
    return analytics.account_analytics(account_change_rows(v), ASOF, 30)


@query("changes_over_min", oracle_text("""
SELECT account_address, block_slot, snapshot_id, lamports_change FROM changes
WHERE abs(CAST(lamports_change AS DOUBLE) / 1e9) >= 1.0""", "changes"))
def changes_over_min(v, spark, sf):
    """Balance changes of at least 1 coin."""
    return analytics.changes_over_min(account_change_rows(v), 1.0).select(
        "account_address", "block_slot", "snapshot_id", "lamports_change")


@query("threshold_alerts", oracle_text("""
SELECT account_address, block_slot, snapshot_id, change_type,
       CASE WHEN change_type = 'DATA_SIZE' THEN 'DATA_SIZE'
            WHEN CAST(regexp_extract(new_value, '^(-?[0-9]+)', 1) AS BIGINT) / 1e9 >= 50.0 THEN 'BALANCE_ABOVE'
            ELSE 'BALANCE_BELOW' END AS alert
FROM changes c JOIN v_tracked t ON t.address = c.account_address
WHERE t.is_active AND (
  (change_type = 'BALANCE' AND (
     (CAST(regexp_extract(old_value, '^(-?[0-9]+)', 1) AS BIGINT) / 1e9 < 50.0
      AND CAST(regexp_extract(new_value, '^(-?[0-9]+)', 1) AS BIGINT) / 1e9 >= 50.0)
     OR (CAST(regexp_extract(old_value, '^(-?[0-9]+)', 1) AS BIGINT) / 1e9 >= 50.0
      AND CAST(regexp_extract(new_value, '^(-?[0-9]+)', 1) AS BIGINT) / 1e9 < 50.0)))
  OR (change_type = 'DATA_SIZE' AND abs(data_size_change) >= 40))""", "changes"))
def threshold_alerts(v, spark, sf):
    """Alerts for active accounts: balance crossing 50 coins, data size change of 40+ bytes."""
    reg = v.tracked.where(F.col("is_active")).select(
        "address", F.lit(50.0).alias("balance_threshold"), F.lit(40).cast("long").alias("data_size_threshold"))
    return analytics.threshold_alerts(account_change_rows(v, active(v)), reg).select(
        "account_address", "block_slot", "snapshot_id", "change_type", "alert")


# -- W2-W8 ----------------------------------------------------------------

def slot_reports(v):
    return v.transactions.select(F.col("program_id").alias("source"), F.col("ts").alias("observed_ts"),
                                 F.col("signature").alias("seq"), "slot",
                                 F.greatest(F.col("slot") - 32, F.lit(0)).alias("finalized_slot"))


@query("slot_progress", oracle_text("""
SELECT source, observed_ts, seq, slot, finalized_slot, slot_delta, finalized_delta FROM (
  SELECT *, coalesce(slot - lag(slot) OVER w, 1) AS slot_delta,
            coalesce(finalized_slot - lag(finalized_slot) OVER w, 1) AS finalized_delta
  FROM (SELECT program_id AS source, ts AS observed_ts, signature AS seq, slot,
               greatest(slot - 32, 0) AS finalized_slot FROM v_transactions)
  WINDOW w AS (PARTITION BY source ORDER BY observed_ts, seq))
WHERE slot_delta > 0"""))
def slot_progress(v, spark, sf):
    """Per reporting source, slot and finalized deltas; only increasing reports."""
    return changes.slot_progress(slot_reports(v))


DUC_SQL = """
SELECT signature, slot, ts FROM (
  SELECT signature, slot, ts, lag(slot) OVER (ORDER BY ts, signature) AS p FROM v_transactions)
WHERE p IS NULL OR p <> slot"""


@query("distinct_until_changed", oracle_text(DUC_SQL))
def distinct_until_changed(v, spark, sf):
    """The slot stream (transactions in arrival order) without consecutive repeats."""
    return changes.distinct_until_changed(v.transactions.select("signature", "slot", "ts"), "slot",
                                          ["ts", "signature"])


@query("slots_processed", oracle_text(f"SELECT count(*) AS slots_processed FROM ({DUC_SQL})"))
def slots_processed(v, spark, sf):
    """Slots counted after repeat suppression."""
    return distinct_until_changed(v, spark, sf).agg(F.count(F.lit(1)).alias("slots_processed"))


LEADER_LAG_SQL = "SELECT slot, leader_pubkey, lag(leader_pubkey) OVER (ORDER BY slot) AS previous_leader " \
                 "FROM v_slot_leaders"


@query("leader_changes", oracle_text(f"""
SELECT slot, leader_pubkey, previous_leader FROM ({LEADER_LAG_SQL})
WHERE previous_leader IS NULL OR previous_leader <> leader_pubkey"""))
def leader_changes(v, spark, sf):
    """Slots where the scheduled leader changes."""
    return changes.leader_changes(v.slot_leaders)


@query("leader_retention", oracle_text("""
SELECT slot, leader_pubkey FROM v_slot_leaders
WHERE slot >= greatest((SELECT max(slot) FROM v_slot_leaders) - 100, 0)"""))
def leader_retention(v, spark, sf):
    """Leader entries within 100 slots of the tip."""
    tip = v.slot_leaders.select(F.max("slot")).scalar()
    return changes.retain_recent(v.slot_leaders, tip, 100)


@query("tx_ordinal", oracle_text("""
SELECT signature, payer, row_number() OVER (PARTITION BY payer ORDER BY slot, ts, signature) AS ordinal
FROM v_transactions"""))
def tx_ordinal(v, spark, sf):
    """Message ordinal per payer."""
    return changes.tx_ordinal(v.transactions, "payer", ["slot", "ts", "signature"]) \
        .select("signature", "payer", "ordinal")


@query("running_latency", oracle_text("""
SELECT request_id, kind, round(avg(response_us) OVER (PARTITION BY kind ORDER BY ts, request_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean
FROM v_access_log"""))
def running_latency(v, spark, sf):
    """Running mean response per request kind."""
    return changes.running_latency(v.access_log).select("request_id", "kind",
                                                        F.round("running_mean", 6).alias("running_mean"))


@query("slot_gaps", oracle_text("""
SELECT slot, parent_slot, previous_slot, missed_slots, reorg, reorg_depth FROM (
  SELECT slot, parent_slot, lag(slot) OVER (ORDER BY slot) AS previous_slot,
         slot - lag(slot) OVER (ORDER BY slot) - 1 AS missed_slots,
         parent_slot < lag(slot) OVER (ORDER BY slot) AS reorg,
         CASE WHEN parent_slot < lag(slot) OVER (ORDER BY slot) THEN lag(slot) OVER (ORDER BY slot) - parent_slot
              ELSE 0 END AS reorg_depth
  FROM v_headers)
WHERE previous_slot IS NOT NULL AND (missed_slots > 0 OR reorg)"""))
def slot_gaps(v, spark, sf):
    """Missed slots and reorgs along the landed headers."""
    return changes.slot_gaps(v.headers)


# -- R5-R7 batch forms ----------------------------------------------------

@query("fresh_state", oracle_text(f"""
SELECT account_address, lamports, data_size, owner, slot, ts FROM latest_snap
WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 2 DAY""", "latest_snap"))
def fresh_state(v, spark, sf):
    """Latest account state per account, kept when written within 2 days of the as-of time."""
    latest = analytics.fresh_state(v.snapshots.select("account_address", "lamports", "data_size", "owner", "slot",
                                                      "ts", "id"),
                                   "account_address", "ts", 2 * 86400, ASOF)
    return latest.select("account_address", "lamports", "data_size", "owner", "slot", "ts")


@query("subscribe_slots", oracle_text("""
SELECT slot, commitment FROM (
  SELECT slot, CASE WHEN slot <= tip - 32 THEN 'finalized' WHEN slot <= tip - 2 THEN 'confirmed'
                    ELSE 'processed' END AS commitment
  FROM v_slots, (SELECT max(slot) AS tip FROM v_slots) m)
WHERE commitment IN ('confirmed', 'processed')"""))
def subscribe_slots(v, spark, sf):
    """Slots whose commitment level is among the requested ones."""
    tip = v.slots.select(F.max("slot")).scalar()
    return ledger.commitment_levels(v.slots, tip).where(F.col("commitment").isin("confirmed", "processed")) \
        .select("slot", "commitment")


@query("subscribe_leaders", oracle_text(f"""
SELECT slot, leader_pubkey, previous_leader FROM ({LEADER_LAG_SQL}) WHERE slot >= 100"""))
def subscribe_leaders(v, spark, sf):
    """Leader entries from slot 100 on (end 0 = unlimited), each with the previous slot's leader."""
    d = with_previous(v.slot_leaders, [], ["slot"], ["leader_pubkey"], out="_p")
    start, end = 100, 0
    slot = F.col("slot")
    d = d.where((slot >= start) & ((F.lit(end) == 0) | (slot <= end)))
    return d.select("slot", "leader_pubkey", F.col("_p.leader_pubkey").alias("previous_leader"))


# -- D1, D3, D4, D9 -------------------------------------------------------

@query("wallet_analytics", oracle_text(f"""
SELECT wallet_address, activity_type, count(*) AS n_activities, CAST(sum(fee) AS BIGINT) AS total_fees,
       min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM v_activities WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{ASOF}'
GROUP BY wallet_address, activity_type"""))
def wallet_analytics(v, spark, sf):
    """Per (wallet, kind) activity analytics over 30 days."""
    return analytics.wallet_analytics(v.activities, ASOF, 30)


MIDDAY = "2024-01-20 12:30:00"


@query("wallet_analytics_rollup", oracle_text(f"""
SELECT wallet_address, activity_type, count(*) AS n_activities, CAST(sum(fee) AS BIGINT) AS total_fees,
       min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM v_activities WHERE ts >= TIMESTAMP '{MIDDAY}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{MIDDAY}'
GROUP BY wallet_address, activity_type"""))
def wallet_analytics_rollup(v, spark, sf):
    """The analytics of 7 days up to a midday from stored days, and from the log for the two half days."""
    path = scratch_path(spark, "activity-days")
    days = analytics.activity_days(v.activities)
    days.write.mode("error").parquet(path)
    return analytics.wallet_analytics_from_days(spark.read.schema(days.schema).parquet(path), v.activities, MIDDAY, 7)


@query("history_range", oracle_text("""
SELECT * FROM v_activities
WHERE wallet_address IN (SELECT address FROM v_tracked WHERE is_active)
  AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"""))
def history_range(v, spark, sf):
    """D3: watched wallets' activities dated 2024-01-10 to 2024-01-12 inclusive, no limit."""
    req = v.tracked.where(F.col("is_active")).select(F.col("address").alias("wallet_address"))
    return ledger.history(v.activities, req, limit=0, start="2024-01-10", end="2024-01-12")


@query("history_by_type", oracle_text("""
SELECT * FROM v_activities
WHERE wallet_address IN (SELECT address FROM v_tracked WHERE is_active) AND activity_type = 'SEND'"""))
def history_by_type(v, spark, sf):
    """Watched wallets' activities of kind 'send', no limit."""
    req = v.tracked.where(F.col("is_active")).select(F.col("address").alias("wallet_address"))
    return ledger.history(v.activities, req, limit=0, kind="send")


@query("history_unknown", oracle_text("""
SELECT * FROM v_activities
WHERE wallet_address IN (SELECT address FROM v_tracked WHERE is_active) AND activity_type = 'UNKNOWN'"""))
def history_unknown(v, spark, sf):
    """Watched wallets' activities of unknown kind."""
    req = v.tracked.where(F.col("is_active")).select(F.col("address").alias("wallet_address"))
    return ledger.history(v.activities, req, limit=0, kind="unknown")


@query("latest_balances", oracle_text("""
SELECT wallet_address, token_mint, id, balance, slot, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet_address, token_mint ORDER BY ts DESC, slot DESC, id DESC) AS rn
  FROM v_balances) WHERE rn = 1"""))
def latest_balances(v, spark, sf):
    """Latest balance per (wallet, token); null mint = native coin."""
    return analytics.latest_balances(v.balances)


@query("leader_conflicts", oracle_text("""
SELECT slot, leader_pubkey, seq, previous_leader FROM (
  SELECT *, lag(leader_pubkey) OVER (PARTITION BY slot ORDER BY seq) AS previous_leader FROM (
    SELECT slot, leader_pubkey, 0 AS seq FROM v_slot_leaders
    UNION ALL SELECT l.slot, n.leader_pubkey, 1 AS seq FROM v_slot_leaders l
              JOIN v_slot_leaders n ON n.slot = l.slot + 1))
WHERE previous_leader IS NOT NULL AND previous_leader <> leader_pubkey"""))
def leader_conflicts(v, spark, sf):
    """A second leader report per slot (read one slot ahead) that contradicts the first."""
    nxt = v.slot_leaders.select((F.col("slot") - 1).alias("slot"), "leader_pubkey")
    second = v.slot_leaders.select("slot").join(nxt, "slot").withColumn("seq", F.lit(1))
    reports = v.slot_leaders.withColumn("seq", F.lit(0)).unionByName(second)
    return changes.leader_conflicts(reports).select("slot", "leader_pubkey", "seq", "previous_leader")
