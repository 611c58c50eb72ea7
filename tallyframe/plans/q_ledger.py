"""Registered queries: lookups, lists, filters, classification and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions import expr
from tallyframe.operators import joins, ledger
from tallyframe.operators.seen import build_filter, merge_filters, new_keys
from tallyframe.plans.registry import HOT_SINCE, SEEN_BEFORE, oracle_text, query
from tallyframe.session import scratch_path
from tallyframe.sources import layout

SLOT_COLS = ["slot", "blockhash", "parent_slot", "finalized", "ts"]
SLOT_BUCKETS = 8  # of the stored relations of the fixtures; ``layout.buckets_for`` sizes others
TX_COLS = ["signature", "slot", "fee", "status", "program_id", "payer", "amount", "ts"]


def account_keys(v):
    """Account keys of each transaction, ordered by position (bounded per signature)."""
    return (v.tx_accounts.groupBy("signature")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "account"))).alias("_k"))
            .select("signature", F.col("_k.account").alias("account_keys")))


def subscription_input(v):
    return (v.transactions.join(account_keys(v), "signature")
            .select("signature", "slot", "fee", "status", "program_id", "account_keys",
                    (F.col("program_id") == "prog0").alias("is_vote"), (F.col("status") == "failed").alias("failed")))


def registry_with_tags(v):
    return v.tracked.withColumn("tags", F.array("tag"))


# -- T1, T2 ---------------------------------------------------------------

@query("recent_finalized", oracle_text(
    "SELECT slot, blockhash, parent_slot, finalized, ts FROM v_slots WHERE finalized ORDER BY slot DESC LIMIT 10"))
def recent_finalized(v, spark, sf):
    """Latest 10 finalized slots."""
    return ledger.recent_slots(v.slots, limit=10, finalized=True).select(*SLOT_COLS)


@query("recent_slots", oracle_text(
    "SELECT slot, blockhash, parent_slot, finalized, ts FROM v_slots ORDER BY slot DESC LIMIT 10"))
def recent_slots(v, spark, sf):
    """Latest 10 slots."""
    return ledger.recent_slots(v.slots, limit=10).select(*SLOT_COLS)


@query("scan_slots", oracle_text(
    "SELECT slot, blockhash, parent_slot, finalized, ts AS timestamp FROM v_slots"))
def scan_slots(v, spark, sf):
    """The slots relation in its stored shape."""
    return v.slots.select("slot", "blockhash", "parent_slot", "finalized", F.col("ts").alias("timestamp"))


# -- P1, P2 lookups -------------------------------------------------------

@query("get_slot", oracle_text("""
SELECT slot, blockhash, parent_slot, finalized, ts FROM v_slots
WHERE slot IN (SELECT block_slot FROM v_activities WHERE activity_type = 'RECEIVE'
               UNION SELECT block_slot + 1000000 FROM v_activities WHERE activity_type = 'RECEIVE')"""))
def get_slot(v, spark, sf):
    """Slots by id for a request table (slots of RECEIVE activities, plus unknown ids)."""
    rec = v.activities.where(F.col("activity_type") == "RECEIVE")
    req = rec.select(F.col("block_slot").alias("slot")).unionByName(
        rec.select((F.col("block_slot") + 1000000).alias("slot")))
    return ledger.lookup(v.slots, req, "slot").select(*SLOT_COLS)


@query("get_transaction", oracle_text("""
SELECT signature, slot, fee, status, program_id, payer, amount, ts FROM v_transactions
WHERE signature IN (SELECT signature FROM v_tx_accounts WHERE pos = 2
                    UNION SELECT concat(signature, 'x') FROM v_tx_accounts WHERE pos = 2)"""))
def get_transaction(v, spark, sf):
    """Transactions by signature (requests include unknown signatures)."""
    third = v.tx_accounts.where(F.col("pos") == 2)
    req = third.select("signature").unionByName(third.select(F.concat("signature", F.lit("x")).alias("signature")))
    return ledger.lookup(v.transactions, req, "signature").select(*TX_COLS)


@query("get_leader", oracle_text("""
SELECT slot, leader_pubkey FROM v_slot_leaders
WHERE slot IN (SELECT slot FROM v_transactions WHERE status = 'failed')"""))
def get_leader(v, spark, sf):
    """Leader by slot for the slots of failed transactions."""
    req = v.transactions.where(F.col("status") == "failed").select("slot")
    return ledger.lookup(v.slot_leaders, req, "slot")


@query("tx_by_slot", oracle_text("""
SELECT signature, slot, fee, status, program_id, payer, amount, ts FROM v_transactions
WHERE slot IN (SELECT slot FROM v_slots WHERE NOT finalized)"""))
def tx_by_slot(v, spark, sf):
    """Transactions of the requested slots (all slots not yet finalized)."""
    req = v.slots.where(~F.col("finalized")).select("slot")
    return ledger.lookup(v.transactions, req, "slot").select(*TX_COLS)


# -- P4, P5, P6 -----------------------------------------------------------

@query("active_registry", oracle_text("SELECT id, address, name, tag, is_active FROM v_tracked WHERE is_active"))
def active_registry(v, spark, sf):
    """P4."""
    return v.tracked.where(F.col("is_active"))


@query("resolve_identifier", oracle_text("""
SELECT h.identifier, h.id, h.prio = 0 AS matched_address, t.address, t.name, t.tag, t.is_active
FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY prio, id) AS rn FROM hits) h
JOIN v_tracked t ON t.id = h.id WHERE h.rn = 1""", extra="""
req AS (SELECT DISTINCT wallet_address AS identifier FROM v_activities
        UNION SELECT name FROM v_tracked WHERE tag = 'BUILDING'
        UNION SELECT 'nobody'),
hits AS (SELECT r.identifier, 0 AS prio, t.id FROM req r JOIN v_tracked t ON t.address = r.identifier
         UNION ALL SELECT r.identifier, 1 AS prio, t.id FROM req r JOIN v_tracked t ON t.name = r.identifier)"""))
def resolve_identifier(v, spark, sf):
    """P5: each requested identifier resolved by address first, then by name."""
    req = (v.activities.select(F.col("wallet_address").alias("identifier"))
           .unionByName(v.tracked.where(F.col("tag") == "BUILDING").select(F.col("name").alias("identifier")))
           .unionByName(spark.range(1).select(F.lit("nobody").alias("identifier"))))
    out = ledger.resolve_identifier(v.tracked, req)
    return out.select("identifier", "id", "matched_address", "address", "name", "tag", "is_active")


@query("activity_filter", oracle_text("""
SELECT * FROM v_activities WHERE lower(replace(activity_type, '_', '')) IN ('send', 'receive')"""))
def activity_filter(v, spark, sf):
    """Kinds 'send' and 'Receive' (case- and underscore-insensitive)."""
    return ledger.activity_filter(v.activities, ["send", "Receive"])


# -- P7, P8 ---------------------------------------------------------------

SUB_SELECT = "signature, slot, fee, status, program_id, array_to_string(account_keys, ',') AS account_keys_text"


def _sub_out(df):
    return df.select("signature", "slot", "fee", "status", "program_id",
                     F.array_join("account_keys", ",").alias("account_keys_text"))


@query("subscription_filter", oracle_text(f"""
SELECT {SUB_SELECT} FROM sub_input
WHERE list_has_any(account_keys, ['prog1', 'prog2', 'prog3'])
  AND NOT list_has_any(account_keys, ['acct00000012', 'acct00000013'])
  AND NOT is_vote AND NOT failed""", "sub_input"))
def subscription_filter(v, spark, sf):
    """Include any of prog1-3, exclude two accounts, no votes, no failures."""
    df = ledger.subscription_filter(subscription_input(v), include=["prog1", "prog2", "prog3"],
                                    exclude=["acct00000012", "acct00000013"], vote=False, failed=False)
    return _sub_out(df)


@query("subscription_required", oracle_text(f"""
SELECT {SUB_SELECT} FROM sub_input
WHERE list_has_all(account_keys, ['prog4', 'acct00000007']) AND NOT is_vote""", "sub_input"))
def subscription_required(v, spark, sf):
    """account_required as all-of."""
    df = ledger.subscription_filter(subscription_input(v), required=["prog4", "acct00000007"], vote=False)
    return _sub_out(df)


@query("watchlist_edit", oracle_text("""
SELECT address FROM (
  SELECT address, arg_max(op, coalesce(seq, -9223372036854775807)) AS op FROM (
    SELECT address, 'add' AS op, CAST(NULL AS BIGINT) AS seq FROM v_tracked WHERE is_active
    UNION ALL
    SELECT wallet_address, CASE WHEN activity_type = 'UNKNOWN' THEN 'remove' ELSE 'add' END, id FROM v_activities)
  GROUP BY address) WHERE op = 'add'"""))
def watchlist_edit(v, spark, sf):
    """Active registry as the watch set; activities add (SEND/RECEIVE) or remove (UNKNOWN) in id order."""
    edits = v.activities.select(F.col("wallet_address").alias("address"),
                                F.when(F.col("activity_type") == "UNKNOWN", "remove").otherwise("add").alias("op"),
                                F.col("id").alias("seq"))
    return ledger.watchlist_edit(v.tracked.where(F.col("is_active")).select("address"), edits)


# -- P13, P14, P15, P18, P21, P23 -----------------------------------------

@query("chain_status", oracle_text("""
SELECT tip, greatest(tip - 2, 0) AS confirmed_slot, greatest(tip - 32, 0) AS finalized_slot,
       tip - greatest(tip - 32, 0) AS finality_lag FROM (SELECT max(slot) AS tip FROM v_slots)"""))
def chain_status(v, spark, sf):
    """P13."""
    return ledger.chain_status(v.slots)


@query("slot_commitment", oracle_text("""
SELECT slot, CASE WHEN slot <= tip - 32 THEN 'finalized' WHEN slot <= tip - 2 THEN 'confirmed' ELSE 'processed' END
       AS commitment
FROM v_slots, (SELECT max(slot) AS tip FROM v_slots) m"""))
def slot_commitment(v, spark, sf):
    """Per-slot commitment level from the tip."""
    tip = v.slots.select(F.max("slot")).scalar()
    return ledger.commitment_levels(v.slots, tip).select("slot", "commitment")


@query("classify_activity", oracle_text("""
SELECT a.signature, a.account AS wallet,
       CASE WHEN NOT regexp_full_match(a.account, 'acct[0-9]{8}') THEN 'UNKNOWN'
            WHEN k.account_keys[1] = a.account THEN CASE WHEN len(k.account_keys) > 2 THEN 'SEND' ELSE 'UNKNOWN' END
            ELSE 'RECEIVE' END AS activity_type
FROM v_tx_accounts a JOIN keys k ON k.signature = a.signature
WHERE a.account LIKE 'acct%'""", "keys"))
def classify_activity(v, spark, sf):
    """Every wallet key of every transaction classified against the transaction's keys."""
    wallets = v.tx_accounts.where(F.col("account").startswith("acct")) \
        .select("signature", F.col("account").alias("wallet"))
    df = wallets.join(account_keys(v), "signature")
    return ledger.classify_activity(df, address_pattern="^acct[0-9]{8}$").select("signature", "wallet",
                                                                                  "activity_type")


@query("account_labels_derived", oracle_text("""
SELECT account_address, lamports, executable, rent_epoch,
       CASE WHEN executable THEN 'Program' ELSE 'Data' END AS account_type,
       CASE WHEN rent_epoch = 0 THEN 'Yes' ELSE 'No' END AS readonly,
       CASE WHEN lamports > 0 THEN 'ACTIVE' ELSE 'EMPTY' END AS account_status
FROM latest_snap""", "latest_snap"))
def account_labels_derived(v, spark, sf):
    """Labels of each account's latest state."""
    latest = ledger.latest_per_key(v.snapshots, "account_address", ["slot", "ts", "id"])
    return ledger.account_labels(latest).select("account_address", "lamports", "executable", "rent_epoch",
                                                "account_type", "readonly", "account_status")


@query("sample_slots", oracle_text("SELECT slot, blockhash FROM v_slots WHERE slot % 3 = 0"))
def sample_slots(v, spark, sf):
    """Every third slot."""
    return ledger.sample_every(v.slots, 3).select("slot", "blockhash")


@query("block_stats", oracle_text(
    "SELECT slot, tx_count, round(CAST(tx_count AS DOUBLE) * 200 / 1e6, 6) AS size_mb FROM v_slots"))
def block_stats(v, spark, sf):
    """Block size estimate from the real transaction count."""
    return v.slots.select("slot", "tx_count", F.round(ledger.block_size_mb(F.col("tx_count")), 6).alias("size_mb"))


@query("tx_access_counts", oracle_text("""
SELECT signature, CAST(count(*) FILTER (WHERE pos >= 1) AS INTEGER) AS n_read,
       CAST(count(*) FILTER (WHERE pos = 0) AS INTEGER) AS n_written,
       coalesce(nullif(max(CASE WHEN pos = 0 THEN account END), ''), 'N/A') AS first_account
FROM v_tx_accounts GROUP BY signature"""))
def tx_access_counts(v, spark, sf):
    """Sizes of the read and written account lists per transaction."""
    per = v.tx_accounts.groupBy("signature").agg(
        F.collect_list(F.when(F.col("pos") >= 1, F.col("account"))).alias("accounts_read"),
        F.collect_list(F.when(F.col("pos") == 0, F.col("account"))).alias("accounts_written"),
        F.max(F.when(F.col("pos") == 0, F.col("account"))).alias("first_account"))
    return ledger.access_counts(per).select("signature", "n_read", "n_written", "first_account")


# -- joins ----------------------------------------------------------------

@query("watched_states", oracle_text("""
SELECT s.*, t.name, t.tag FROM v_snapshots s JOIN v_tracked t ON t.address = s.account_address WHERE t.is_active"""))
def watched_states(v, spark, sf):
    """States of watched (active) accounts with registry name and tag."""
    return joins.watched_states(v.snapshots, v.tracked)


@query("multi_get_transactions", oracle_text(f"""
SELECT signature, slot, fee, status, program_id, payer, amount, ts,
       CASE WHEN prio = 0 THEN 'hot' ELSE 'store' END AS source
FROM (SELECT u.*, row_number() OVER (PARTITION BY signature ORDER BY prio) AS rn
      FROM (SELECT *, 0 AS prio FROM v_transactions WHERE ts >= TIMESTAMP '{HOT_SINCE}'
            UNION ALL SELECT *, 1 AS prio FROM v_transactions) u
      WHERE signature IN (SELECT signature FROM v_tx_accounts WHERE pos = 2
                          UNION SELECT concat(signature, 'x') FROM v_tx_accounts WHERE pos = 2))
WHERE rn = 1"""))
def multi_get_transactions(v, spark, sf):
    """Hot source (recent transactions) first, then the store; unknown keys dropped."""
    third = v.tx_accounts.where(F.col("pos") == 2)
    req = third.select("signature").unionByName(third.select(F.concat("signature", F.lit("x")).alias("signature")))
    hot = v.transactions.where(F.col("ts") >= F.lit(HOT_SINCE).cast("timestamp_ntz"))
    return joins.multi_get(req, hot.select(*TX_COLS), v.transactions.select(*TX_COLS), "signature")


NEW_SIGNATURES = oracle_text(f"""
SELECT wallet_address AS address, transaction_signature AS signature, ts FROM v_activities a
WHERE NOT EXISTS (SELECT 1 FROM v_activities s WHERE s.ts < TIMESTAMP '{SEEN_BEFORE}'
                  AND s.wallet_address = a.wallet_address AND s.transaction_signature = a.transaction_signature)""")


@query("new_signatures", NEW_SIGNATURES)
def new_signatures(v, spark, sf):
    """(address, signature) pairs not in the seen set (activities before a cut-off)."""
    cur = v.activities.select(F.col("wallet_address").alias("address"),
                              F.col("transaction_signature").alias("signature"), "ts")
    seen = cur.where(F.col("ts") < F.lit(SEEN_BEFORE).cast("timestamp_ntz"))
    return ledger.new_signatures(cur, seen)


@query("new_signatures_filtered", NEW_SIGNATURES)
def new_signatures_filtered(v, spark, sf):
    """J3/U1 against a large seen set: stored filters of two halves of the seen days, a range a day, merged and looked up."""
    cur = v.activities.select(F.col("wallet_address").alias("address"), F.col("transaction_signature").alias("signature"), "ts")
    seen = cur.where(F.col("ts") < F.lit(SEEN_BEFORE).cast("timestamp_ntz"))
    day = F.unix_date(F.col("ts").cast("date"))
    stored = []
    for half in (day % 2 == 0, day % 2 != 0):
        path = scratch_path(spark, "seen-filter")
        part = build_filter(seen.where(half), ["address", "signature"], day)
        part.write.parquet(path)
        stored.append(spark.read.schema(part.schema).parquet(path))
    return new_keys(cur, seen, merge_filters(*stored))


@query("fk_orphans", oracle_text("""
SELECT slot, count(*) AS n_rows FROM v_transactions t
WHERE NOT EXISTS (SELECT 1 FROM v_headers h WHERE h.slot = t.slot) GROUP BY slot"""))
def fk_orphans(v, spark, sf):
    """Transactions whose slot has no landed header."""
    return joins.fk_orphans(v.transactions, v.headers, "slot")


TX_ENRICHED = oracle_text("""
SELECT t.signature, t.slot, t.fee, t.status, h.blockhash, h.ts AS block_ts, l.leader_pubkey
FROM v_transactions t LEFT JOIN v_headers h ON h.slot = t.slot LEFT JOIN v_slot_leaders l ON l.slot = t.slot""")


@query("tx_enriched", TX_ENRICHED)
def tx_enriched(v, spark, sf):
    """Transaction -> landed header -> leader."""
    return joins.tx_enriched(v.transactions, v.headers, v.slot_leaders).select(
        "signature", "slot", "fee", "status", "blockhash", "block_ts", "leader_pubkey")


@query("tx_enriched_stored", TX_ENRICHED)
def tx_enriched_stored(v, spark, sf):
    """The three relations stored by slot with declared schemas, and joined bucket by bucket, without a shuffle."""
    headers = v.headers.withColumn("finalized", F.lit(True))
    tx, slots, leaders = (layout.store(df, scratch_path(spark, "by-slot"), schema, SLOT_BUCKETS)
                          for df, schema in ((v.transactions, schemas.TRANSACTIONS), (headers, schemas.SLOTS), (v.slot_leaders, schemas.SLOT_LEADERS)))
    return joins.tx_enriched(tx, slots, leaders).select("signature", "slot", "fee", "status", "blockhash", "block_ts", "leader_pubkey")


@query("label_enrich", oracle_text("""
SELECT w.wallet_address, b.label, b.label_type, b.confidence
FROM (SELECT DISTINCT wallet_address FROM v_balances) w
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY confidence DESC, id) AS rn
                          FROM v_labels) WHERE rn = 1) b ON b.address = w.wallet_address"""))
def label_enrich(v, spark, sf):
    """Each wallet with its highest-confidence label."""
    wallets = v.balances.select("wallet_address").distinct()
    return joins.label_enrich(wallets, v.labels, "wallet_address")


@query("get_account", oracle_text("""
SELECT t.address, coalesce(s.lamports, 0) AS lamports, coalesce(s.owner, '11111111111111111111111111111111') AS owner,
       coalesce(s.executable, false) AS executable, coalesce(s.rent_epoch, 0) AS rent_epoch,
       coalesce(s.data_size, 0) AS data_size, s.owner IS NOT NULL AS found
FROM v_tracked t LEFT JOIN latest_snap s ON s.account_address = t.address""", "latest_snap"))
def get_account(v, spark, sf):
    """Every registry address with its latest state or the default account."""
    latest = ledger.latest_per_key(v.snapshots, "account_address", ["slot", "ts", "id"]) \
        .withColumnRenamed("account_address", "address")
    return joins.get_account(v.tracked.select("address"), latest)


@query("tx_by_program", oracle_text("""
SELECT signature, slot FROM v_transactions WHERE signature IN (
  SELECT signature FROM v_tx_accounts WHERE account IN ('prog2', 'prog5'))"""))
def tx_by_program(v, spark, sf):
    """Transactions whose program list contains prog2 or prog5."""
    tx = v.transactions.join(
        v.tx_accounts.where(F.col("account").startswith("prog")).groupBy("signature")
        .agg(F.collect_list("account").alias("program_ids")), "signature")
    return joins.tx_by_program(tx, ["prog2", "prog5"]).select("signature", "slot")


# -- T3-T7 ----------------------------------------------------------------

@query("wallet_history", oracle_text("""
SELECT wallet_address, id, activity_type, transaction_signature, ts, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet_address ORDER BY ts DESC, id DESC) AS rank
  FROM v_activities WHERE wallet_address IN (SELECT address FROM v_tracked WHERE is_active))
WHERE rank <= 50"""))
def wallet_history(v, spark, sf):
    """Newest 50 activities of every active watched wallet."""
    req = v.tracked.where(F.col("is_active")).select(F.col("address").alias("wallet_address"))
    return ledger.history(v.activities, req, limit=50).select(
        "wallet_address", "id", "activity_type", "transaction_signature", "ts", "rank")


@query("latest_tx", oracle_text("""
SELECT payer, signature, slot, fee, status, CASE WHEN status IS NOT NULL THEN 'CONFIRMED' ELSE 'UNKNOWN' END
       AS confirmation
FROM (SELECT *, row_number() OVER (PARTITION BY payer ORDER BY slot DESC, signature DESC) AS rn FROM v_transactions)
WHERE rn = 1"""))
def latest_tx(v, spark, sf):
    """Latest transaction per payer."""
    latest = ledger.latest_per_key(v.transactions.select("payer", "signature", "slot", "fee", "status"),
                                   "payer", ["slot", "signature"])
    return latest.withColumn("confirmation", ledger.confirmation_label(F.col("status")))


@query("last_k_signatures", oracle_text("""
SELECT payer, signature, slot, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY payer ORDER BY slot DESC, signature DESC) AS rank FROM v_transactions)
WHERE rank <= 10"""))
def last_k_signatures(v, spark, sf):
    """The 10 latest signatures per payer."""
    return ledger.top_k_per_key(v.transactions, "payer", [F.col("slot").desc(), F.col("signature").desc()], 10) \
        .select("payer", "signature", "slot", "rank")


REG_SQL = """
SELECT t.id, t.address, t.name, t.tag, t.is_active, a.last_activity, coalesce(a.activity_count, 0) AS activity_count,
       CASE WHEN t.is_active THEN 'Active' ELSE 'Inactive' END AS registry_status
FROM v_tracked t LEFT JOIN (SELECT wallet_address, max(ts) AS last_activity, count(*) AS activity_count
                            FROM v_activities GROUP BY wallet_address) a ON a.wallet_address = t.address"""


def registry_view(v):
    from tallyframe.operators.maintenance import registry_counters
    return registry_counters(v.tracked, v.activities)


@query("list_registry", oracle_text(REG_SQL))
def list_registry(v, spark, sf):
    """T4: registry with counters, listed by name (the fixture has no created_at)."""
    return ledger.list_registry(registry_view(v), sort="name")


@query("list_registry_sorted", oracle_text(
    f"SELECT * FROM ({REG_SQL}) WHERE is_active ORDER BY activity_count DESC, id"))
def list_registry_sorted(v, spark, sf):
    """Active registry sorted by activity, id tie-break."""
    return ledger.list_registry(registry_view(v), sort="activity", active=True)


@query("registry_by_tag", oracle_text(
    "SELECT id, address, name, tag, is_active, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS registry_status "
    "FROM v_tracked WHERE tag IN ('BUILDING', 'MACHINERY')"))
def registry_by_tag(v, spark, sf):
    """Registry rows whose tags overlap the requested tags."""
    return ledger.list_registry(registry_with_tags(v), sort="name", tags=["BUILDING", "MACHINERY"]).drop("tags")


@query("multi_get_cached_count", oracle_text(f"""
SELECT count(*) FILTER (WHERE prio = 0) AS cached_count, count(*) AS total_count
FROM (SELECT u.*, row_number() OVER (PARTITION BY signature ORDER BY prio) AS rn
      FROM (SELECT *, 0 AS prio FROM v_transactions WHERE ts >= TIMESTAMP '{HOT_SINCE}'
            UNION ALL SELECT *, 1 AS prio FROM v_transactions) u
      WHERE signature IN (SELECT signature FROM v_tx_accounts WHERE pos = 2))
WHERE rn = 1"""))
def multi_get_cached_count(v, spark, sf):
    """Keys served from the hot source, and the total resolved."""
    return joins.cached_count(multi_get_transactions(v, spark, sf))


@query("ensure_parents", oracle_text("""
SELECT DISTINCT t.slot, 'unknown_blockhash' AS blockhash, false AS finalized FROM v_transactions t
WHERE NOT EXISTS (SELECT 1 FROM v_headers h WHERE h.slot = t.slot)"""))
def ensure_parents(v, spark, sf):
    """Placeholder slot rows to insert before transactions whose slot has no header."""
    return joins.ensure_parents(v.transactions, v.headers, "slot",
                                {"blockhash": "unknown_blockhash", "finalized": False})


@query("history_export", oracle_text("""
SELECT wallet_address, id, activity_type, transaction_signature, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet_address ORDER BY ts DESC, id DESC) AS rank
  FROM v_activities WHERE wallet_address IN (SELECT address FROM v_tracked WHERE is_active))
WHERE rank <= 50"""))
def history_export(v, spark, sf):
    """Watched wallets' histories exported as gzip JSON lines and read back."""
    from tallyframe.operators.maintenance import write_table
    hist = wallet_history(v, spark, sf).drop("ts")
    path = write_table(hist, scratch_path(spark, "history-export"), fmt="json", compression="gzip")
    return spark.read.schema(hist.schema).json(path)


# -- T4, T7 by creation time and balance; D6 by program; scalar display helpers ---

LISTED_SQL = """
listed AS (SELECT t.*, TIMESTAMP '2024-01-01' + to_hours(t.id % 500) AS created_at, 'prog' || (t.id % 7) AS program_id, b.balance
           FROM v_tracked t LEFT JOIN (SELECT wallet_address, arg_max(balance, (ts, slot, id)) AS balance FROM v_balances
                                       WHERE token_mint IS NULL GROUP BY 1) b ON b.wallet_address = t.address)"""


def listed(v):
    """The registry with a creation time, a program and the latest native balance."""
    from tallyframe.operators.analytics import latest_balances
    native = latest_balances(v.balances.where(F.col("token_mint").isNull())).select(F.col("wallet_address").alias("address"), "balance")
    created = F.timestamp_add("HOUR", F.col("id") % 500, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return v.tracked.withColumn("created_at", created).withColumn("program_id", F.concat(F.lit("prog"), (F.col("id") % 7).cast("string"))).join(native, "address", "left")


def whole_listing(v, sort, by):
    """All entries of a listing in its order, each with its place, so that the order itself is checked.

    Places count down ``by`` with an id tie-break; entries without a value follow by id.
    """
    from tallyframe.operators.sequence import with_ordinal
    down = -(expr.unix_micros_ntz(by) if by == "created_at" else F.col(by))
    entries = listed(v).select("id", "address", "is_active", by, F.col(by).isNull().alias("_none"), down.alias("_down"))
    placed = with_ordinal(entries, [], ["_none", "_down", "id"], out="place")
    return ledger.list_registry(placed, sort=sort).select("place", "id", "address", "registry_status")


@query("list_registry_created", oracle_text("""
SELECT row_number() OVER (ORDER BY created_at DESC, id) AS place, id, address, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS registry_status
FROM listed""", extra=LISTED_SQL))
def list_registry_created(v, spark, sf):
    """The default listing, newest entries first."""
    return whole_listing(v, "created", "created_at")


@query("list_registry_balance", oracle_text("""
SELECT row_number() OVER (ORDER BY balance DESC NULLS LAST, id) AS place, id, address, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS registry_status
FROM listed""", extra=LISTED_SQL))
def list_registry_balance(v, spark, sf):
    """The listing by balance, largest first, entries without one last."""
    return whole_listing(v, "balance", "balance")


@query("registry_by_program", oracle_text("""
SELECT id, address, name, program_id, CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS registry_status FROM listed WHERE program_id = 'prog3'""", extra=LISTED_SQL))
def registry_by_program(v, spark, sf):
    """Registry entries of one program."""
    return ledger.list_registry(listed(v), sort="name", program_id="prog3").select("id", "address", "name", "program_id", "registry_status")


@query("registry_display", oracle_text("""
SELECT signature, CASE WHEN fee % 7 = 0 THEN 'No fee' ELSE printf('%.9f SOL', fee / 1e9) END AS fee_text,
       substr(signature, 1, 5) || '...' || substr(signature, length(signature) - 4, 5) AS short, substr(status, 1, 4) AS head,
       CASE WHEN slot % 3 = 0 THEN 0 ELSE 2 END AS n_tags, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown_at, strftime(ts, '%m-%d %H:%M:%S') AS shown_short,
       CASE WHEN slot % 2 = 0 THEN 'Unnamed' ELSE payer END AS shown_name,
       CASE WHEN slot % 4 = 0 THEN 'SEND' WHEN slot % 4 = 1 THEN 'STAKE' ELSE 'UNKNOWN' END AS shown_kind
FROM v_transactions"""))
def registry_display(v, spark, sf):
    """the texts a listing shows."""
    kind = F.when(F.col("slot") % 4 == 0, "send").when(F.col("slot") % 4 == 1, "Stake").when(F.col("slot") % 4 == 2, F.col("program_id"))
    tags = F.when(F.col("slot") % 3 == 0, "not json").otherwise('["a", "b"]')
    return v.transactions.select(
        "signature", expr.fee_text(F.when(F.col("fee") % 7 == 0, F.lit(0)).otherwise(F.col("fee"))).alias("fee_text"), expr.short_address("signature", 5, 5).alias("short"),
        expr.prefix("status", 4).alias("head"), F.size(expr.json_string_array(tags)).alias("n_tags"), expr.display_time("ts").alias("shown_at"),
        expr.display_time("ts", short=True).alias("shown_short"), expr.name_or_default(F.when(F.col("slot") % 2 != 0, F.col("payer"))).alias("shown_name"),
        expr.enum_or_unknown(kind, schemas.WALLET_ACTIVITY_TYPES).alias("shown_kind"))
