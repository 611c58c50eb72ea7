"""Registered queries: sources, ingest normalisation and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.expr import BASE58_ALPHABET, BASE58_PATTERN, address_bounds, is_valid_address, unix_micros_ntz
from tallyframe.operators import maintenance
from tallyframe.operators.stored import RangeTable
from tallyframe.plans.registry import INGEST_TS, oracle_text, query
from tallyframe.session import scratch_path
from tallyframe.sources import ingest

SLOTS_A_RANGE = 4096  # of the stored slots


@query("ingest_headers", oracle_text(
    "SELECT slot, blockhash, parent_slot, true AS finalized, ts AS timestamp FROM v_headers"))
def ingest_headers(v, spark, sf):
    """S3: landed headers as slots rows."""
    return ingest.ingest_headers(v.headers, INGEST_TS)


@query("ingest_headers_fallback", oracle_text(f"""
SELECT slot, CASE WHEN slot % 11 = 0 THEN 'unknown_blockhash' ELSE blockhash END AS blockhash,
       CASE WHEN slot % 11 = 0 THEN greatest(slot - 1, 0) ELSE parent_slot END AS parent_slot, slot % 11 <> 0 AS finalized,
       CASE WHEN slot % 11 = 0 OR slot % 5 = 0 THEN TIMESTAMP '{INGEST_TS}' ELSE ts END AS timestamp
FROM v_headers"""))
def ingest_headers_fallback(v, spark, sf):
    """Headers of which some failed to arrive (every 11th slot) or lack a block time (every 5th)."""
    failed = F.col("slot") % 11 == 0
    headers = v.headers.select("slot", F.when(~failed, F.col("blockhash")).alias("blockhash"), F.when(~failed, F.col("parent_slot")).alias("parent_slot"),
                               F.when(~failed & (F.col("slot") % 5 != 0), F.col("ts")).alias("ts"))
    return ingest.ingest_headers(headers, INGEST_TS)


@query("ingest_recent_slots", oracle_text(f"""
SELECT r.slot, coalesce(h.blockhash, 'unknown_blockhash') AS blockhash,
       CASE WHEN h.blockhash IS NOT NULL THEN h.parent_slot ELSE greatest(r.slot - 1, 0) END AS parent_slot,
       h.blockhash IS NOT NULL AND r.slot <= (SELECT max(slot) FROM v_headers) - 32 AS finalized,
       coalesce(h.ts, TIMESTAMP '{INGEST_TS}') AS timestamp
FROM (SELECT unnest(generate_series(0, (SELECT max(slot) FROM v_headers))) AS slot) r
LEFT JOIN v_headers h ON h.slot = r.slot"""))
def ingest_recent_slots(v, spark, sf):
    """Every slot from 0 to the landed tip; missing headers become placeholder rows."""
    tip = v.headers.select(F.max("slot")).scalar()
    return ingest.ingest_recent_slots(spark, v.headers, tip, tip + 1, INGEST_TS)


@query("ingest_leaders", oracle_text("SELECT slot, leader_pubkey FROM v_slot_leaders"))
def ingest_leaders(v, spark, sf):
    """Leader schedules (start slot + ordered list of 100) expanded to one row per slot."""
    sched = (v.slot_leaders.groupBy((F.floor(F.col("slot") / 100) * 100).cast("long").alias("start_slot"))
             .agg(F.sort_array(F.collect_list(F.struct("slot", "leader_pubkey"))).alias("_l"))
             .select("start_slot", F.col("_l.leader_pubkey").alias("leaders")))
    return ingest.ingest_leaders(sched)


def signature_bytes() -> Column:
    """64 bytes for a signature, of which every 13th slot's begin with zero bytes."""
    hexed = F.concat(F.sha2("signature", 256), F.sha2(F.reverse("signature"), 256))
    return F.unhex(F.when(F.col("slot") % 13 == 0, F.overlay(hexed, F.lit("000000"), 1)).otherwise(hexed))


def raw_transactions(v):
    """Landed raw transactions: prog6 rows arrive without metadata, prog5 rows without block time; signatures are bytes."""
    t = v.transactions
    meta = F.when(F.col("program_id") == "prog6", F.lit(None)).otherwise(
        F.struct(F.col("fee").alias("fee"),
                 F.when(F.col("status") == "failed", F.lit("InstructionError")).alias("err")))
    return t.select(signature_bytes().alias("signature"), "slot", meta.alias("meta"),
                    F.when(F.col("program_id") == "prog5", F.lit(None).cast("long"))
                    .otherwise(F.floor(unix_micros_ntz("ts") / 1000000).cast("long")).alias("block_time"),
                    F.array("program_id").alias("program_ids"))


def base58_sql(source: str, columns: str) -> str:
    """CTEs that end in ``encoded``: ``columns`` of ``source`` and ``b58``, the base-58 text of its 128 hex digits ``h``.

    32-bit chunks are summed with their weights into limbs of base 58**9 in 128-bit integers, then the limbs are carried."""
    limb, n_limbs = 58 ** 9, 10
    chunks = ", ".join(f"CAST(CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT) AS HUGEINT) AS c{i}" for i in range(16))
    totals = ", ".join("CAST(" + " + ".join(f"c{i} * {(1 << 32 * (15 - i)) // limb ** j % limb}" for i in range(16)) + f" AS HUGEINT) AS r{j}" for j in range(n_limbs))
    ctes = [f"b58_chunks AS (SELECT *, {chunks} FROM {source})", f"b58_0 AS (SELECT *, CAST(0 AS HUGEINT) AS carry, {totals} FROM b58_chunks)"]
    ctes += [f"b58_{j + 1} AS (SELECT * EXCLUDE (carry), (r{j} + carry) % {limb} AS g{j}, (r{j} + carry) // {limb} AS carry FROM b58_{j})" for j in range(n_limbs)]
    digits = ", ".join(f"substr('{BASE58_ALPHABET}', CAST(g{j} // {58 ** k} % 58 AS INTEGER) + 1, 1)" for j in reversed(range(n_limbs)) for k in reversed(range(9)))
    zeros = "length(regexp_extract(h, '^(00)*', 0)) // 2"
    return ",\n".join([*ctes, f"encoded AS (SELECT {columns}, concat(repeat('1', {zeros}), ltrim(concat({digits}), '1')) AS b58 FROM b58_{n_limbs})"])


@query("ingest_transactions", oracle_text(f"""
SELECT b58 AS signature, slot, CASE WHEN program_id = 'prog6' THEN 0 ELSE fee END AS fee,
       CASE WHEN program_id <> 'prog6' AND status <> 'failed' THEN 'success' ELSE 'failed' END AS status,
       CASE WHEN program_id = 'prog5' THEN TIMESTAMP '{INGEST_TS}'
            ELSE TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) END AS ts,
       program_id AS program_ids_text
FROM encoded""", extra="""signed AS (
  SELECT *, CASE WHEN slot % 13 = 0 THEN concat('000000', substr(hexed, 7)) ELSE hexed END AS h
  FROM (SELECT *, concat(sha256(signature), sha256(reverse(signature))) AS hexed FROM v_transactions))""" + ",\n" + base58_sql("signed", "slot, fee, status, program_id, ts")))
def ingest_transactions(v, spark, sf):
    """Normalise raw transactions (signature text, status, fee default, block time fallback)."""
    return ingest.normalise_transactions(raw_transactions(v), INGEST_TS).select(
        "signature", "slot", "fee", "status", "ts", F.array_join("program_ids", ",").alias("program_ids_text"))


@query("flow_blocks", oracle_text("""
SELECT slot AS height, signature AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp
FROM v_transactions WHERE status = 'success'"""))
def flow_blocks(v, spark, sf):
    """Latest-block documents (failed calls carry an error instead of a result)."""
    t = v.transactions
    doc = F.when(F.col("status") == "failed", F.to_json(F.struct(F.struct(F.lit(-32000).alias("code"))
                                                                   .alias("error"))))\
        .otherwise(F.to_json(F.struct(F.struct(F.col("slot").alias("height"), F.col("signature").alias("id"),
                                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
                                      .alias("result"))))
    return ingest.flow_blocks(t.select(doc.alias("doc")))


@query("flow_events", oracle_text(
    "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'purchase'"))
def flow_events(v, spark, sf):
    """Events of type 'purchase'."""
    return ingest.flow_events(v.t.events, "purchase").select("event_id", "ts", "user_id", "event_type", "value")


@query("flow_success", oracle_text("SELECT signature, slot, fee FROM v_transactions WHERE status = 'success'"))
def flow_success(v, spark, sf):
    """Successful transactions."""
    return v.transactions.where(F.col("status") == "success").select("signature", "slot", "fee")


@query("flow_tx_events", oracle_text("""
SELECT signature, pos, account FROM v_tx_accounts
WHERE signature IN (SELECT signature FROM v_transactions WHERE status = 'failed')"""))
def flow_tx_events(v, spark, sf):
    """The account events of the requested (failed) transactions."""
    req = v.transactions.where(F.col("status") == "failed").select("signature")
    return v.tx_accounts.join(req, "signature", "left_semi")


@query("scan_tx_jsonl", oracle_text("""
SELECT signature, slot, fee, status, program_id AS program_ids_text, ts FROM v_transactions"""))
def scan_tx_jsonl(v, spark, sf):
    """The transaction log written as JSON lines (sample record shape) and read back typed."""
    path = scratch_path(spark, "tx-jsonl")
    ingest.to_tx_jsonl(v.transactions.withColumn("program_ids", F.array("program_id"))) \
        .write.mode("error").json(path)
    back = ingest.read_tx_jsonl(spark, path)
    return back.select("signature", "slot", "fee", "status",
                       F.array_join("program_ids", ",").alias("program_ids_text"), "ts")


LINE_SQL = """
SELECT signature, slot, fee, CASE WHEN fee % 13 = 0 THEN substr(line, 1, 40)
       WHEN fee % 17 = 0 THEN replace(line, '"slot":', '"place":') WHEN fee % 19 = 0 THEN replace(line, 'T', ' at ') ELSE line END AS line
FROM (SELECT *, concat('{"signature":"', signature, '","slot":', CAST(slot AS VARCHAR), ',"fee":', CAST(fee AS VARCHAR), ',"status":"', status,
             '","programIds":["', program_id, '"],"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '"}') AS line FROM v_transactions)"""


@query("scan_tx_jsonl_rejects", oracle_text(f"""
SELECT CASE WHEN reason IS NULL THEN signature END AS signature, CASE WHEN reason IS NULL THEN slot ELSE -1 END AS slot,
       CASE WHEN reason IS NOT NULL THEN line END AS line, reason
FROM (SELECT *, CASE WHEN fee % 13 = 0 THEN 'malformed' WHEN fee % 17 = 0 THEN 'slot' WHEN fee % 19 = 0 THEN 'timestamp' END AS reason
      FROM ({LINE_SQL}))"""))
def scan_tx_jsonl_rejects(v, spark, sf):
    """A log in which some lines are cut, lack their slot or have no ISO time: typed rows and rejects (slot -1), no line lost."""
    path = scratch_path(spark, "tx-broken")
    fee = F.col("fee")
    line = F.concat(F.lit('{"signature":"'), "signature", F.lit('","slot":'), F.col("slot").cast("string"), F.lit(',"fee":'), fee.cast("string"),
                    F.lit(',"status":"'), "status", F.lit('","programIds":["'), "program_id", F.lit('"],"timestamp":"'),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"}'))
    broken = (F.when(fee % 13 == 0, F.substring(line, 1, 40)).when(fee % 17 == 0, F.replace(line, F.lit('"slot":'), F.lit('"place":')))
              .when(fee % 19 == 0, F.replace(line, F.lit("T"), F.lit(" at "))).otherwise(line))
    v.transactions.select(broken.alias("value")).write.mode("error").text(path)
    rows, rejects = ingest.read_tx_jsonl_checked(spark, path)
    return rows.select("signature", "slot").unionByName(rejects.withColumn("slot", F.lit(-1).cast("long")), allowMissingColumns=True)


# -- K1, K2, K4, K5 -------------------------------------------------------

@query("upsert_slots", oracle_text("""
SELECT slot, blockhash, parent_slot, finalized, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY slot ORDER BY ingest_seq DESC) AS rn FROM (
    SELECT slot, blockhash, parent_slot, false AS finalized, ts, 0 AS ingest_seq FROM v_slots
    UNION ALL SELECT slot, blockhash, parent_slot, true, ts, 1 FROM v_headers))
WHERE rn = 1"""))
def upsert_slots(v, spark, sf):
    """K1: unfinalized slots upserted with landed headers (whole-row replace)."""
    target = v.slots.select("slot", "blockhash", "parent_slot", F.lit(False).alias("finalized"), "ts",
                            F.lit(0).alias("ingest_seq"))
    batch = ingest.ingest_headers(v.headers, INGEST_TS).withColumnRenamed("timestamp", "ts").withColumn("ingest_seq", F.lit(1))
    return maintenance.upsert(target, batch, "slot").select("slot", "blockhash", "parent_slot", "finalized", "ts")


@query("upsert_slots_stored", oracle_text("""
SELECT s.slot, CASE WHEN s.slot > m.tip - 100 THEN concat('fork', s.blockhash) ELSE s.blockhash END AS blockhash, s.parent_slot,
       s.slot <= m.tip - 100 AND h.slot IS NOT NULL AS finalized, s.ts
FROM v_slots s LEFT JOIN v_headers h ON h.slot = s.slot CROSS JOIN (SELECT max(slot) AS tip FROM v_slots) m"""))
def upsert_slots_stored(v, spark, sf):
    """K1 written back: slots stored by ranges, headers upserted over them, then the newest 100 slots replaced, twice as after a
    lost writer; the last batch rewrites the ranges of its slots only."""
    columns = ["slot", "blockhash", "parent_slot", "finalized", "ts"]
    seeds = v.slots.withColumn("finalized", F.lit(False)).withColumn("ingest_seq", F.lit(0)).select(*columns, "ingest_seq")
    landed = ingest.ingest_headers(v.headers, INGEST_TS).withColumnRenamed("timestamp", "ts").withColumn("ingest_seq", F.lit(0))
    fork = seeds.where(F.col("slot") > v.slots.select(F.max("slot")).scalar() - 100).withColumn("blockhash", F.concat(F.lit("fork"), "blockhash"))
    table = RangeTable(spark, scratch_path(spark, "slots-stored"), seeds.select(*columns).schema, width=SLOTS_A_RANGE)
    for batch_id, batch in enumerate((seeds, landed, fork)):
        table.upsert(batch, batch_id)
    table.upsert(fork, 2)
    return table.read()


@query("insert_absent", oracle_text("""
SELECT id, address, name, tag, is_active FROM v_tracked
UNION ALL
SELECT id, address, name, tag, is_active FROM (
  SELECT 5000000 + id AS id, wallet_address AS address, CAST(NULL AS VARCHAR) AS name, 'wallet' AS tag,
         true AS is_active, row_number() OVER (PARTITION BY wallet_address ORDER BY id) AS rn
  FROM v_activities) b
WHERE rn = 1 AND address NOT IN (SELECT address FROM v_tracked)"""))
def insert_absent(v, spark, sf):
    """Register every active wallet not yet in the registry; first write wins."""
    batch = v.activities.select((F.lit(5000000) + F.col("id")).alias("id"), F.col("wallet_address").alias("address"),
                                F.lit(None).cast("string").alias("name"), F.lit("wallet").alias("tag"),
                                F.lit(True).alias("is_active"), F.col("id").alias("ingest_seq"))
    return maintenance.insert_absent(v.tracked, batch, "address")


@query("registry_counters", oracle_text("""
SELECT t.id, t.address, t.name, t.tag, t.is_active, a.last_activity, coalesce(a.activity_count, 0) AS activity_count
FROM v_tracked t LEFT JOIN (SELECT wallet_address, max(ts) AS last_activity, count(*) AS activity_count
                            FROM v_activities GROUP BY wallet_address) a ON a.wallet_address = t.address"""))
def registry_counters(v, spark, sf):
    """K4: last activity and activity count per registry entry."""
    return maintenance.registry_counters(v.tracked, v.activities)


REMOVE_REQ = """
req AS (SELECT address AS identifier FROM v_tracked WHERE tag = 'AUTOMOBILE'
        UNION SELECT name FROM v_tracked WHERE tag = 'FURNITURE'),
removed AS (SELECT address FROM v_tracked WHERE address IN (SELECT identifier FROM req)
            OR name IN (SELECT identifier FROM req))"""


def _removed(v):
    req = (v.tracked.where(F.col("tag") == "AUTOMOBILE").select(F.col("address").alias("identifier"))
           .unionByName(v.tracked.where(F.col("tag") == "FURNITURE").select(F.col("name").alias("identifier"))))
    return maintenance.registry_remove(v.tracked, req)


@query("registry_remove", oracle_text("""
SELECT * FROM v_tracked WHERE address NOT IN (SELECT address FROM removed)""", extra=REMOVE_REQ))
def registry_remove(v, spark, sf):
    """K5: registry after removing entries requested by address (AUTOMOBILE) or name (FURNITURE)."""
    return maintenance.remove_keys(v.tracked, _removed(v), "address")


@query("registry_remove_activities", oracle_text("""
SELECT * FROM v_activities WHERE wallet_address NOT IN (SELECT address FROM removed)""", extra=REMOVE_REQ))
def registry_remove_activities(v, spark, sf):
    """K5: activities remaining after the removed entries' activities are deleted."""
    return maintenance.remove_keys(v.activities, _removed(v), "wallet_address")


# -- P19, K6 ----------------------------------------------------------------

# Candidate keys: the hex digits of a digest as 44 base-58 digits, of which those that begin with a zero digit are too short.
HEX, DIGITS, KEY_CHARS = "0123456789abcdef", "123456789ABCDEFG", 44

_BOUNDS = ", ".join(f"({k}, '{low}', '{high}')" for k, (low, high) in enumerate(address_bounds()))
CANDIDATES_SQL = f"""
candidates AS (SELECT id, name, CASE WHEN tag = 'HOUSEHOLD' THEN translate(substr(sha256(address), 1, {KEY_CHARS}), '{HEX}', '{DIGITS}') ELSE address END AS address FROM v_tracked),
split AS (SELECT *, ltrim(address, '1') AS rest, length(address) - length(ltrim(address, '1')) AS k FROM candidates),
bounds(k, low, high) AS (VALUES {_BOUNDS}),
checked AS (SELECT id, name, address, regexp_matches(address, '{BASE58_PATTERN}') AND coalesce(
    (length(rest), rest) >= (length(low), low) AND (length(rest), rest) < (length(high), high), s.k = 32 AND rest = '') AS valid
  FROM split s LEFT JOIN bounds b ON b.k = s.k)"""


def candidate_addresses(v):
    """Registry candidates: HOUSEHOLD customers get a key-like text, others their raw id text."""
    key = F.translate(F.substring(F.sha2("address", 256), 1, KEY_CHARS), HEX, DIGITS)
    return v.tracked.select("id", "name", F.when(F.col("tag") == "HOUSEHOLD", key).otherwise(F.col("address"))
                            .alias("address"))


@query("valid_addresses", oracle_text("SELECT id, name, address, valid FROM checked", extra=CANDIDATES_SQL))
def valid_addresses(v, spark, sf):
    """Candidate addresses with the base-58 public-key check."""
    return candidate_addresses(v).withColumn("valid", is_valid_address("address"))


@query("registry_add", oracle_text("""
SELECT id, address, name, is_active, CAST(0 AS BIGINT) AS activity_count FROM v_tracked
UNION ALL
SELECT id + 9000000, address, name, true, 0 FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY id) AS rn FROM checked WHERE valid)
WHERE rn = 1 AND address NOT IN (SELECT address FROM v_tracked)""", extra=CANDIDATES_SQL))
def registry_add(v, spark, sf):
    """K6: valid new addresses registered with count 0 and active; existing addresses ignored."""
    cand = candidate_addresses(v).withColumn("valid", is_valid_address("address"))
    target = v.tracked.select("id", "address", "name", "is_active", F.lit(0).cast("long").alias("activity_count"))
    batch = cand.where("valid").select((F.col("id") + 9000000).alias("id"), "address", "name",
                                       F.lit(True).alias("is_active"), F.lit(0).cast("long").alias("activity_count"),
                                       F.col("id").alias("ingest_seq"))
    return maintenance.insert_absent(target, batch, "address")


SEED_SQL = """
SELECT r.slot, coalesce(h.blockhash, 'unknown_blockhash') AS blockhash,
       CASE WHEN h.blockhash IS NOT NULL THEN h.parent_slot ELSE greatest(r.slot - 1, 0) END AS parent_slot,
       h.blockhash IS NOT NULL AND r.slot <= (SELECT max(slot) FROM v_headers) - 32 AS finalized
FROM (SELECT unnest(generate_series((SELECT max(slot) FROM v_headers) - 5, (SELECT max(slot) FROM v_headers)))
      AS slot) r
LEFT JOIN v_headers h ON h.slot = r.slot"""


def _seeded(v, spark, table):
    tip = v.headers.select(F.max("slot")).scalar()
    seed = ingest.ingest_recent_slots(spark, v.headers, tip, 6, INGEST_TS).select("slot", "blockhash", "parent_slot", "finalized")
    return maintenance.seed_if_empty(table.select(*seed.columns), seed)


@query("seed_slots", oracle_text(SEED_SQL))
def seed_slots(v, spark, sf):
    """K9: seed an empty slots table with the tip and the 5 slots before it."""
    return _seeded(v, spark, v.slots.where("slot < 0"))


@query("seed_slots_present", oracle_text("SELECT slot, blockhash, parent_slot, finalized FROM v_slots WHERE slot % 2 = 0"))
def seed_slots_present(v, spark, sf):
    """K9: a slots table that has rows gets none."""
    return _seeded(v, spark, v.slots.where("slot % 2 = 0"))


@query("track_finalized", oracle_text("""
SELECT slot, blockhash, parent_slot, slot <= (SELECT max(slot) FROM v_slots) - 32 AS finalized, ts FROM v_slots"""))
def track_finalized(v, spark, sf):
    """Slots followed at the finalized level only, and saved over the rows of a table of unfinalized slots (K1)."""
    from tallyframe.operators import ledger
    tip = v.slots.select(F.max("slot")).scalar()
    columns = ["slot", "blockhash", "parent_slot", "finalized", "ts"]
    news = ledger.commitment_levels(v.slots, tip).where(F.col("commitment") == "finalized").withColumn("finalized", F.lit(True))
    table = v.slots.withColumn("finalized", F.lit(False)).select(*columns)
    return maintenance.upsert(table, news.withColumn("ingest_seq", F.lit(1)).select(*columns, "ingest_seq"), "slot")
