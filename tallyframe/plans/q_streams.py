"""Registered queries: the streaming operators, drained with ``availableNow`` and read back.

The streams read the given table itself (``Tables(streaming=True)``). Each stream's oracle is its
batch twin's SQL: the stream must produce the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.plans.fixtures import LedgerViews
from tallyframe.plans.q_ledger import SUB_SELECT, _sub_out
from tallyframe.plans.q_sequences import CHANGE_COLS, DUC_SQL
from tallyframe.plans.registry import ASOF, oracle_text, query
from tallyframe.sources.tables import Tables
from tallyframe.streaming import streams


def _streaming(spark, sf):
    return LedgerViews(Tables(spark, sf, streaming=True))


@query("stream_account_changes", oracle_text("SELECT * FROM changes", "changes"))
def stream_account_changes(v, spark, sf):
    """Account change detection, micro-batch by micro-batch."""
    return streams.run_account_changes(spark, _streaming(spark, sf).snapshots).select(*CHANGE_COLS)


def _sightings(spark, sf):
    return _streaming(spark, sf).activities.select(F.col("wallet_address").alias("address"), F.col("transaction_signature").alias("signature"), "ts")


@query("stream_new_signatures", oracle_text("""
SELECT DISTINCT wallet_address AS address, transaction_signature AS signature FROM v_activities"""))
def stream_new_signatures(v, spark, sf):
    """R2: first sighting of every (address, signature) pair, with bounded state (an event is repeated within a day, if at all)."""
    src = _sightings(spark, sf)
    path = streams.run_batches(spark, src, lambda p: streams.new_signature_batches(p, delay="1 day"), "new-signatures")
    return streams.BatchFolders(path).read(spark, "out", src.schema).select("address", "signature")


@query("stream_recent_signatures", oracle_text("""
SELECT wallet_address AS address, transaction_signature AS signature, ts FROM v_activities
QUALIFY row_number() OVER (PARTITION BY wallet_address ORDER BY ts DESC, transaction_signature DESC) <= 10"""))
def stream_recent_signatures(v, spark, sf):
    """R2 as polled: what is new on each address's list of its last 10 signatures (one file, one poll), at a processing-time interval."""
    src = _sightings(spark, sf)
    path = streams.run_batches(spark, src, streams.recent_signature_batches, "recent-signatures", processing_time="1 second")
    return streams.BatchFolders(path).read(spark, "out", src.schema).select("address", "signature", "ts")


@query("stream_fresh_state", oracle_text(f"""
SELECT account_address, lamports, data_size, owner, slot, ts FROM latest_snap WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 2 DAY""", "latest_snap"))
def stream_fresh_state(v, spark, sf):
    """The account states that live for two days after they were written, kept by a stream and read as of a time."""
    columns = ["lamports", "data_size", "owner", "slot"]
    src = _streaming(spark, sf).snapshots.select("account_address", *columns, "ts", "id")
    path = streams.run_batches(spark, src, lambda p: streams.fresh_state_batches(p, "account_address", columns, "2 days"), "fresh-state")
    now = F.lit(ASOF).cast("timestamp_ntz")
    alive = streams.fresh(spark, path, src.schema, "account_address", columns, now, "2 days")
    return alive.select("account_address", *columns, F.col("written").alias("ts"))


@query("stream_slots", oracle_text(DUC_SQL))
def stream_slots(v, spark, sf):
    """The slot stream without consecutive repeats."""
    return streams.run_slot_changes(spark, _streaming(spark, sf).transactions)


@query("stream_tx_filter", oracle_text(f"""
SELECT {SUB_SELECT} FROM sub_input
WHERE list_has_any(account_keys, ['prog1', 'prog2', 'prog3'])
  AND NOT list_has_any(account_keys, ['acct00000012', 'acct00000013'])
  AND NOT is_vote AND NOT failed""", "sub_input"))
def stream_tx_filter(v, spark, sf):
    """The subscription filter over a pushed transaction stream."""
    out = streams.filtered_tx_stream(_streaming(spark, sf).pushed_transactions, include=["prog1", "prog2", "prog3"],
                                     exclude=["acct00000012", "acct00000013"], vote=False, failed=False)
    return streams.run_available_now(_sub_out(out), spark, "tx-filter")


@query("stream_batch_rate", oracle_text("""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, n, n / 3600.0 AS per_second
FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM v_access_log GROUP BY 1)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM v_access_log) - INTERVAL 1 HOUR"""))
def stream_batch_rate(v, spark, sf):
    """Request rate per hour, for the hours that the watermark (one hour behind) has closed."""
    by_hour = T.StructType([T.StructField(c, t()) for c, t in (("window_start", T.TimestampNTZType), ("window_end", T.TimestampNTZType), ("n", T.LongType), ("per_second", T.DoubleType))])
    path = streams.run_batches(spark, _streaming(spark, sf).access_log, streams.batch_rate_batches, "batch-rate")
    return streams.BatchFolders(path).read(spark, "out", by_hour).drop("batch_id")
