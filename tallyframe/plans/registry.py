"""Registry of named queries (Spark) and their DuckDB oracles (SQL over the same parquet tables).

Oracles inline the ledger-shaped views of FIXTURES.md §3 as CTEs; the Spark
side builds the same views with the DataFrame API (``plans/fixtures.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans.fixtures import LedgerViews
from tallyframe.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Fixed parameters of the registered queries.
ASOF = "2024-01-30 00:00:00"
INGEST_TS = "2024-02-01 00:00:00"
SEEN_BEFORE = "2024-01-15 00:00:00"
HOT_SINCE = "2024-01-25 00:00:00"
ARCHIVE_NOW = 1702000000
ARCHIVE_DAYS = 10
REJECT_BYTES = 16384  # archive_rejects alone, to exercise the limit; the archive itself takes 100 MiB

VIEW_SQL = {
    "v_transactions": """
SELECT concat('sig', lpad(CAST(event_id AS STRING), 10, '0')) AS signature,
       CAST(floor(event_id / 10) AS BIGINT) AS slot,
       5000 + event_id % 10000 AS fee,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       concat('prog', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 AS STRING)) AS program_id,
       concat('acct', lpad(CAST(user_id AS STRING), 8, '0')) AS payer,
       value AS amount, ts
FROM events""",
    "v_slots": """
SELECT t.slot, concat('bh', lpad(CAST(t.slot AS STRING), 8, '0')) AS blockhash,
       greatest(t.slot - 1, 0) AS parent_slot,
       t.slot < greatest(m.cur - 31, 0) AS finalized, t.ts, t.tx_count
FROM (SELECT slot, min(ts) AS ts, count(*) AS tx_count FROM v_transactions GROUP BY slot) t
CROSS JOIN (SELECT max(slot) AS cur FROM v_transactions) m""",
    "v_headers": """
SELECT slot, blockhash, parent_slot, ts, tx_count FROM v_slots WHERE slot % 7 <> 0""",
    "v_slot_leaders": """
SELECT sl.slot, s.s_name AS leader_pubkey
FROM v_slots sl JOIN supplier s
  ON s.s_suppkey = CAST(floor(sl.slot / 4) AS BIGINT) % (SELECT count(*) FROM supplier)""",
    "v_tracked": """
SELECT c_custkey AS id, concat('acct', lpad(CAST(c_custkey AS STRING), 8, '0')) AS address,
       c_name AS name, c_mktsegment AS tag, c_acctbal >= 0 AS is_active
FROM customer""",
    "v_snapshots": """
SELECT event_id AS id, concat('acct', lpad(CAST(user_id AS STRING), 8, '0')) AS account_address,
       CAST(round(value * 100) AS BIGINT) * 10000000 AS lamports,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS data_size,
       event_type AS owner, event_type = 'signup' AS executable,
       CAST(floor(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 10) AS BIGINT) AS rent_epoch,
       CAST(floor(event_id / 10) AS BIGINT) AS slot, ts
FROM events""",
    "v_tx_accounts": """
SELECT signature, 0 AS pos, payer AS account FROM v_transactions
UNION ALL SELECT signature, 1 AS pos, program_id AS account FROM v_transactions
UNION ALL SELECT concat('sig', lpad(CAST(event_id AS STRING), 10, '0')) AS signature, 2 AS pos,
                 concat('acct', lpad(CAST((user_id + 1) AS STRING), 8, '0')) AS account
          FROM events WHERE event_type <> 'view'""",
    "v_activities": """
SELECT event_id AS id, concat('acct', lpad(CAST(user_id AS STRING), 8, '0')) AS wallet_address,
       CASE WHEN event_type = 'view' THEN 'UNKNOWN' WHEN event_type = 'signup' THEN 'RECEIVE' ELSE 'SEND' END AS activity_type,
       concat('sig', lpad(CAST(event_id AS STRING), 10, '0')) AS transaction_signature,
       CAST(floor(event_id / 10) AS BIGINT) AS block_slot, 5000 + event_id % 10000 AS fee,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS amount, ts
FROM events""",
    "v_balances": """
SELECT event_id AS id, concat('acct', lpad(CAST(user_id AS STRING), 8, '0')) AS wallet_address,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('mint', CAST(event_id % 3 AS STRING)) END AS token_mint,
       value AS balance, CAST(floor(event_id / 10) AS BIGINT) AS slot, ts
FROM events""",
    "v_labels": """
SELECT c_custkey AS id, concat('acct', lpad(CAST(c_custkey AS STRING), 8, '0')) AS address,
       c_mktsegment AS label, 'custom' AS label_type, CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence
FROM customer
UNION ALL
SELECT c_custkey + 1000000 AS id, concat('acct', lpad(CAST(c_custkey AS STRING), 8, '0')) AS address,
       'exchange' AS label, 'exchange' AS label_type, CAST(0.5 AS DOUBLE) AS confidence
FROM customer WHERE c_nationkey % 2 = 0""",
    "v_access_log": """
SELECT event_id AS request_id, event_type AS kind, value < 40 AS hit,
       CAST(round(value * 10) AS BIGINT) AS response_us,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS bytes, ts
FROM events""",
    "v_archive": """
SELECT doc_id, concat('doc', CAST(doc_id AS STRING)) AS name, text AS payload, n_chars AS size,
       1700000000 + doc_id * 3600 AS uploaded_at, doc_id % 5 = 0 AS pinned
FROM documents""",
}

# Reusable oracle fragments (CTEs built on the views).
SQL_FRAGMENTS = {
    # Previous state per account, then one branch per changed field.
    "changes": """
SELECT account_address, slot AS block_slot, ts AS timestamp, id AS snapshot_id, activity_type, change_type,
       old_value, new_value, lamports_change, data_size_change,
       concat('account_change_', account_address, '_', CAST(slot AS VARCHAR), '_',
              CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS VARCHAR)) AS transaction_signature
FROM (
  SELECT *, 'BALANCE_CHANGE' AS activity_type, 'BALANCE' AS change_type,
         CAST(p_lamports AS VARCHAR) || ' lamports' AS old_value, CAST(lamports AS VARCHAR) || ' lamports' AS new_value,
         lamports - p_lamports AS lamports_change, CAST(0 AS BIGINT) AS data_size_change
  FROM snap_prev WHERE has_prev AND lamports IS DISTINCT FROM p_lamports
  UNION ALL
  SELECT *, 'DATA_CHANGE', 'DATA_SIZE', CAST(p_data_size AS VARCHAR) || ' bytes', CAST(data_size AS VARCHAR) || ' bytes',
         0, data_size - p_data_size
  FROM snap_prev WHERE has_prev AND data_size IS DISTINCT FROM p_data_size
  UNION ALL
  SELECT *, 'OWNER_CHANGE', 'OWNER', p_owner, owner, 0, 0
  FROM snap_prev WHERE has_prev AND owner IS DISTINCT FROM p_owner
  UNION ALL
  SELECT *, 'EXECUTABLE_CHANGE', 'EXECUTABLE', CAST(p_executable AS VARCHAR), CAST(executable AS VARCHAR), 0, 0
  FROM snap_prev WHERE has_prev AND executable IS DISTINCT FROM p_executable
  UNION ALL
  SELECT *, 'RENT_EPOCH_CHANGE', 'RENT_EPOCH', CAST(p_rent_epoch AS VARCHAR), CAST(rent_epoch AS VARCHAR), 0, 0
  FROM snap_prev WHERE has_prev AND rent_epoch IS DISTINCT FROM p_rent_epoch
) c""",
    "snap_prev": """
SELECT *,
       row_number() OVER w > 1 AS has_prev,
       lag(lamports) OVER w AS p_lamports, lag(data_size) OVER w AS p_data_size, lag(owner) OVER w AS p_owner,
       lag(executable) OVER w AS p_executable, lag(rent_epoch) OVER w AS p_rent_epoch
FROM v_snapshots
WINDOW w AS (PARTITION BY account_address ORDER BY slot, ts, id)""",
    "keys": """
SELECT signature, list(account ORDER BY pos) AS account_keys FROM v_tx_accounts GROUP BY signature""",
    "sub_input": """
SELECT t.signature, t.slot, t.fee, t.status, t.program_id, k.account_keys,
       t.program_id = 'prog0' AS is_vote, t.status = 'failed' AS failed
FROM v_transactions t JOIN keys k ON k.signature = t.signature""",
    "latest_snap": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_address ORDER BY slot DESC, ts DESC, id DESC) AS rn
               FROM v_snapshots) WHERE rn = 1""",
    "cids": """
SELECT *, 'bafybeib' || (
  SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, g * 5 + 1, 5) AS INTEGER) >> sh) & 31) + 1, 1), '' ORDER BY g, sh DESC)
  FROM range(8) r(g), (VALUES (15), (10), (5), (0)) s(sh)) AS cid
FROM (SELECT *, sha256(payload) AS h FROM v_archive)""",
    "manifest": """
SELECT cid, name, original_size, mime_type, uploaded_at, pinned, encrypted, checksum FROM (
  SELECT cid, name, CAST(strlen(payload) AS BIGINT) AS original_size, 'text/plain' AS mime_type,
         CAST(uploaded_at AS BIGINT) AS uploaded_at, pinned, false AS encrypted, h AS checksum,
         row_number() OVER (PARTITION BY cid ORDER BY uploaded_at DESC, name DESC) AS rn
  FROM cids WHERE strlen(payload) <= 104857600) WHERE rn = 1""",
}

_FRAGMENT_DEPS = {"changes": ["snap_prev"], "sub_input": ["keys"], "manifest": ["cids"]}


def oracle_text(body: str, *fragments: str, extra: str = "") -> str:
    """Full oracle SQL: all views, the named fragments (with their deps), extra CTEs, then the body."""
    names: list[str] = []
    for f in fragments:
        for d in _FRAGMENT_DEPS.get(f, []) + [f]:
            if d not in names:
                names.append(d)
    ctes = [f"{n} AS ({sql.strip()})" for n, sql in VIEW_SQL.items()]
    ctes += [f"{n} AS ({SQL_FRAGMENTS[n].strip()})" for n in names]
    if extra.strip():
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def query(name: str, sql: str | None = None):
    """Register a Spark query function ``fn(views, spark, sf_dir)`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(LedgerViews(Tables(spark, sf_dir)), spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
