"""Edge rows (FIXTURES §4): empty input, one row, null optional fields, slot 0, repeated keys,
late and out-of-order rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import analytics, changes, joins, ledger, maintenance, metrics
from tallyframe.session import scratch_path
from tallyframe.sources import ingest
from tallyframe.streaming import streams

T0 = dt.datetime(2024, 1, 1)
SNAP = "id long, account_address string, lamports long, data_size long, owner string, executable boolean, " \
       "rent_epoch long, slot long, ts timestamp_ntz"


def _snap(i, lam, size, slot, owner="o", addr="A"):
    return (i, addr, lam, size, owner, False, 1, slot, T0 + dt.timedelta(seconds=slot))


def _key(df):
    return sorted(tuple(r) for r in df.select("account_address", "snapshot_id", "activity_type", "old_value",
                                               "new_value", "lamports_change", "data_size_change").collect())


def test_empty_and_single_row_inputs(spark):
    empty = spark.createDataFrame([], SNAP)
    assert changes.account_changes(empty).count() == 0
    assert changes.account_changes(spark.createDataFrame([_snap(1, 5, 1, 0)], SNAP)).count() == 0
    assert ledger.latest_per_key(empty, "account_address", ["slot", "ts", "id"]).count() == 0
    assert metrics.throughput(spark.createDataFrame([], "ts timestamp_ntz")).first().per_second == 0.0
    one = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    assert metrics.throughput(one).first().per_second == 0.0  # zero span is zero-safe


def test_null_fields_are_changes_and_batch_equals_stream(spark):
    rows = [_snap(1, 5, None, 0), _snap(2, 5, 3, 1), _snap(3, None, 3, 2), _snap(4, 7, None, 3),
            _snap(5, 7, None, 4, owner=None)]
    df = spark.createDataFrame(rows, SNAP)
    batch = changes.account_changes(df, rows=2)
    got = {(r.snapshot_id, r.change_type): (r.old_value, r.new_value, r.lamports_change, r.data_size_change)
           for r in batch.collect()}
    assert got == {(2, "DATA_SIZE"): (None, "3 bytes", 0, None), (3, "BALANCE"): ("5 lamports", None, None, 0),
                   (4, "BALANCE"): (None, "7 lamports", None, 0), (4, "DATA_SIZE"): ("3 bytes", None, 0, None),
                   (5, "OWNER"): ("o", None, 0, 0)}
    land = scratch_path(spark, "t-null")
    for lo in (0, 2, 4):
        spark.createDataFrame(rows[lo:lo + 2], SNAP).coalesce(1).write.mode("append").parquet(land)
    src = streams.read_stream(spark, land, df.schema)
    stream = streams.run_account_changes(spark, src, "t-null-out")
    assert _key(stream) == _key(batch)


def test_stream_rejects_late_states_and_sorts_out_of_order(spark):
    land = scratch_path(spark, "t-late")
    first = [_snap(3, 30, 1, 3), _snap(1, 10, 1, 1), _snap(2, 20, 1, 2)]  # out of order inside a batch
    late = [_snap(0, 99, 1, 0), _snap(4, 40, 1, 4)]                       # slot 0 arrives after slot 3
    for part in (first, late):
        spark.createDataFrame(part, SNAP).coalesce(1).write.mode("append").parquet(land)
    src = streams.read_stream(spark, land, spark.createDataFrame([], SNAP).schema)
    got = streams.run_account_changes(spark, src, "t-late-out")
    assert sorted((r.snapshot_id, r.old_value, r.new_value) for r in got.collect()) == [
        (2, "10 lamports", "20 lamports"), (3, "20 lamports", "30 lamports"), (4, "30 lamports", "40 lamports")]


def test_repeated_keys(spark):
    tgt = spark.createDataFrame([], "k long, v string, ingest_seq long")
    bat = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "k long, v string, ingest_seq long")
    assert [r.v for r in maintenance.upsert(tgt, bat, "k").collect()] == ["c"]
    assert [r.v for r in maintenance.insert_absent(tgt.drop("ingest_seq"), bat, "k").collect()] == ["a"]
    req = spark.createDataFrame([(7,), (7,), (8,)], "slot long")
    slots = spark.createDataFrame([(7, "x")], "slot long, blockhash string")
    assert ledger.lookup(slots, req, "slot").count() == 1


def test_slot_zero_and_placeholders(spark):
    headers = spark.createDataFrame([(0, "bh0", 0, T0), (2, "bh2", 1, T0)],
                                    "slot long, blockhash string, parent_slot long, ts timestamp_ntz")
    got = {r.slot: (r.blockhash, r.parent_slot, r.finalized)
           for r in ingest.ingest_recent_slots(spark, headers, 2, 10, "2024-02-01 00:00:00").collect()}
    assert got == {0: ("bh0", 0, False), 1: ("unknown_blockhash", 0, False), 2: ("bh2", 1, False)}
    assert changes.retain_recent(headers, 2, 100).count() == 2


def test_raw_transaction_normalisation(spark):
    raw = spark.createDataFrame(
        [("s1", 1, (5000, None), 1704067200, ["p"]), ("s2", 1, (7000, "Err"), None, ["p"]),
         ("s3", 2, None, None, None)],
        "signature string, slot long, meta struct<fee:long,err:string>, block_time long, program_ids array<string>")
    got = {r.signature: (r.fee, r.status, r.ts) for r in ingest.normalise_transactions(raw, "2024-02-01").collect()}
    assert got == {"s1": (5000, "success", T0), "s2": (7000, "failed", dt.datetime(2024, 2, 1)),
                   "s3": (0, "failed", dt.datetime(2024, 2, 1))}


def test_flow_blocks_skip_rows_without_result(spark):
    docs = spark.createDataFrame([('{"result":{"height":5,"id":"b5","timestamp":"t"}}',), ('{"error":{}}',),
                                  ('not json',), ('{"result":{"height":6}}',)], "doc string")
    assert [(r.height, r.id) for r in ingest.flow_blocks(docs).collect()] == [(5, "b5")]


def test_latest_balances_null_mint_is_native_group(spark):
    b = spark.createDataFrame([(1, "w", None, 1.0, 1, T0), (2, "w", None, 2.0, 2, T0), (3, "w", "m", 9.0, 1, T0)],
                              "id long, wallet_address string, token_mint string, balance double, slot long, "
                              "ts timestamp_ntz")
    got = sorted((r.token_mint or "", r.balance) for r in analytics.latest_balances(b).collect())
    assert got == [("", 2.0), ("m", 9.0)]


def test_get_account_defaults(spark):
    req = spark.createDataFrame([("x",), ("y",)], "address string")
    st = spark.createDataFrame([("x", 5, "tok", True, 3, 10, 1)],
                               "address string, lamports long, owner string, executable boolean, rent_epoch long, "
                               "data_size long, slot long")
    got = {r.address: (r.lamports, r.owner, r.found) for r in joins.get_account(req, st).collect()}
    assert got == {"x": (5, "tok", True), "y": (0, "11111111111111111111111111111111", False)}


def test_activity_filter_all_and_underscores(spark):
    df = spark.createDataFrame([("BALANCE_CHANGE",), ("OWNER_CHANGE",)], "activity_type string")
    assert ledger.activity_filter(df, ["all"]).count() == 2
    assert [r.activity_type for r in ledger.activity_filter(df, ["balancechange"]).collect()] == ["BALANCE_CHANGE"]
    assert ledger.activity_filter(df.where(F.lit(False)), ["owner_change"]).count() == 0


def test_no_machine_local_folder_on_a_cluster():
    import pytest

    from tallyframe.session import _private_dir
    assert _private_dir("local[4]") and _private_dir("local")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _private_dir(master)


def test_archive_limit_rejects_and_counts(spark):
    from tallyframe.operators import archive
    df = spark.createDataFrame([("a", "x" * 10, 1, False), ("b", "x" * 11, 2, False)], "name string, payload string, uploaded_at long, pinned boolean")
    man, rejected = archive.archive(df, max_bytes=10)
    assert [r.name for r in man.collect()] == ["a"] and [r.name for r in rejected.collect()] == ["b"]
    assert archive.MAX_BYTES == 100 * 1024 * 1024


def test_history_of_unknown_kind(spark):
    df = spark.createDataFrame([(1, "w", "SEND", T0), (2, "w", "UNKNOWN", T0), (3, "w", "odd", T0), (4, "w", None, T0)],
                               "id long, wallet_address string, activity_type string, ts timestamp_ntz")
    req = df.select("wallet_address").distinct()
    assert sorted(r.id for r in ledger.history(df, req, limit=0, kind="unknown").collect()) == [2, 3, 4]
    assert [r.id for r in ledger.history(df, req, limit=0, kind="send").collect()] == [1]


def test_seed_only_when_empty(spark):
    rows, seed = (spark.createDataFrame([(k,)], "k long") for k in (1, 2))
    assert [r.k for r in maintenance.seed_if_empty(rows.limit(0), seed).collect()] == [2]
    assert [r.k for r in maintenance.seed_if_empty(rows, seed).collect()] == [1]


def test_percentiles_interpolate_like_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(k, int(x)) for k in ("a", "b", None) for x in rng.integers(0, 50, {"a": 1, "b": 40}.get(k, 333))] + [("a", None)]
    got = metrics.latency_summary(spark.createDataFrame(rows, "kind string, response_us long")).collect()
    for r in got:
        x = [v for k, v in rows if k == r.kind and v is not None]
        assert np.allclose([r.mean_us, r.min_us, r.max_us, r.p50_us, r.p95_us, r.p99_us], [np.mean(x), min(x), max(x), *np.percentile(x, [50, 95, 99])])
    assert len(got) == 3


def test_listings_place_every_entry(spark):
    """All entries of the registry are listed, those past the 100th and those without a balance too."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from tallyframe.sources.tables import FIXTURE_TABLES

    from .conftest import SF_SMALL
    con = duckdb.connect()
    for t in FIXTURE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name in ("list_registry_created", "list_registry_balance"):
        whole = oracle_sql()[name]
        want = con.execute(f"SELECT place, id, address, registry_status FROM ({whole}) ORDER BY place").fetchall()
        got = [tuple(r) for r in queries()[name](spark, SF_SMALL).collect()]
        assert got == want and len(got) > 100
    assert con.execute(f"SELECT count(*) FROM read_parquet('{SF_SMALL}/customer.parquet')").fetchone() == (len(got),)
