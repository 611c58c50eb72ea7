"""Golden micro-cases with hand-computed answers."""

import base64
import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tallyframe.functions.expr import content_id, fee_text, saturating_sub, short_address
from tallyframe.operators import archive, changes, joins, ledger, maintenance, metrics

T0 = dt.datetime(2024, 1, 1)
SNAP = "id long, account_address string, lamports long, data_size long, owner string, executable boolean, " \
       "rent_epoch long, slot long, ts timestamp_ntz"


def snap(i, addr, lam, size, owner, exe, rent, slot):
    return (i, addr, lam, size, owner, exe, rent, slot, T0 + dt.timedelta(seconds=slot))


def test_account_changes_golden(spark):
    rows = [
        snap(1, "A", 100, 10, "sys", False, 5, 1),      # first state: nothing
        snap(2, "A", 100, 10, "sys", False, 5, 2),      # no change
        snap(3, "A", 250, 12, "tok", True, 6, 3),       # all five change at once
        snap(4, "A", 200, 12, "tok", True, 6, 700),     # balance only, across a chunk edge
        snap(5, "B", 7, 0, "sys", False, 0, 3),         # single state of another account
    ]
    df = spark.createDataFrame(rows, SNAP)
    got = changes.account_changes(df).orderBy("snapshot_id", "activity_type")
    out = [(r.snapshot_id, r.activity_type, r.change_type, r.old_value, r.new_value, r.lamports_change,
            r.data_size_change) for r in got.collect()]
    assert out == [
        (3, "BALANCE_CHANGE", "BALANCE", "100 lamports", "250 lamports", 150, 0),
        (3, "DATA_CHANGE", "DATA_SIZE", "10 bytes", "12 bytes", 0, 2),
        (3, "EXECUTABLE_CHANGE", "EXECUTABLE", "false", "true", 0, 0),
        (3, "OWNER_CHANGE", "OWNER", "sys", "tok", 0, 0),
        (3, "RENT_EPOCH_CHANGE", "RENT_EPOCH", "5", "6", 0, 0),
        (4, "BALANCE_CHANGE", "BALANCE", "250 lamports", "200 lamports", -50, 0),
    ]
    sig = got.where("snapshot_id = 4").first().transaction_signature
    assert sig == f"account_change_A_700_{int((T0 + dt.timedelta(seconds=700)).replace(tzinfo=dt.timezone.utc).timestamp())}"


def test_lamports_change_sums_to_last_minus_first(spark):
    rows = [snap(i, "A", lam, 1, "o", False, 1, s) for i, (lam, s) in
            enumerate([(5, 1), (9, 300), (2, 301), (2, 900), (40, 2000)])]
    df = spark.createDataFrame(rows, SNAP)
    total = changes.account_changes(df).agg(F.sum("lamports_change")).first()[0]
    assert total == 40 - 5


def test_classify_activity(spark):
    df = spark.createDataFrame([("w", ["w", "a", "b"]), ("w", ["w", "a"]), ("w", ["a", "w"]), ("w", ["x"]),
                                ("bad!", ["bad!", "a", "b"])], "wallet string, account_keys array<string>")
    got = [r.activity_type for r in ledger.classify_activity(df, address_pattern="^[a-z]+$").collect()]
    assert got == ["SEND", "UNKNOWN", "RECEIVE", "RECEIVE", "UNKNOWN"]


def test_commitment_near_slot_zero(spark):
    df = spark.createDataFrame([(s,) for s in range(0, 6)], "slot long")
    got = {r.slot: r.commitment for r in ledger.commitment_levels(df, 5).collect()}
    assert got == {0: "confirmed", 1: "confirmed", 2: "confirmed", 3: "confirmed", 4: "processed", 5: "processed"}
    st = ledger.chain_status(df).first()
    assert (st.tip, st.confirmed_slot, st.finalized_slot, st.finality_lag) == (5, 3, 0, 5)


def test_upsert_last_write_wins_and_idempotent(spark):
    tgt = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, ingest_seq long")
    bat = spark.createDataFrame([(2, "b1", 1), (2, "b2", 2), (3, "c", 1)], "k long, v string, ingest_seq long")
    once = maintenance.upsert(tgt, bat, "k")
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, "b2"), (3, "c")]
    twice = maintenance.upsert(once, bat, "k")
    assert sorted((r.k, r.v) for r in twice.collect()) == [(1, "a"), (2, "b2"), (3, "c")]


def test_insert_absent_first_write_wins_and_idempotent(spark):
    tgt = spark.createDataFrame([(1, "a")], "k long, v string")
    bat = spark.createDataFrame([(1, "x", 0), (2, "b1", 5), (2, "b0", 3)], "k long, v string, ingest_seq long")
    once = maintenance.insert_absent(tgt, bat, "k")
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, "b0")]
    assert sorted(map(tuple, maintenance.insert_absent(once, bat, "k").collect())) == sorted(map(tuple, once.collect()))


def test_multi_get_priority_and_missing(spark):
    req = spark.createDataFrame([("s1",), ("s2",), ("s9",), ("s1",)], "signature string")
    hot = spark.createDataFrame([("s1", 10)], "signature string, fee long")
    store = spark.createDataFrame([("s1", 1), ("s2", 2)], "signature string, fee long")
    got = joins.multi_get(req, hot, store, "signature")
    assert sorted((r.signature, r.fee, r.source) for r in got.collect()) == [("s1", 10, "hot"), ("s2", 2, "store")]
    cc = joins.cached_count(got).first()
    assert (cc.cached_count, cc.total_count) == (1, 2)
    assert joins.multi_get(req, hot, store, "signature", limit=1).count() == 1


def test_subscription_filter_empty_lists_pass_all(spark):
    df = spark.createDataFrame([("s", ["a", "b"], False, False), ("t", ["c"], True, True)],
                               "signature string, account_keys array<string>, is_vote boolean, failed boolean")
    assert ledger.subscription_filter(df).count() == 2
    assert [r.signature for r in ledger.subscription_filter(df, required=["a", "b"]).collect()] == ["s"]
    assert [r.signature for r in ledger.subscription_filter(df, exclude=["a"]).collect()] == ["t"]
    assert ledger.subscription_filter(df, vote=False, failed=False).count() == 1


def test_hit_ratio_empty_is_zero(spark):
    empty = spark.createDataFrame([], "kind string, hit boolean, response_us long")
    r = metrics.hit_ratio(empty).first()
    assert (r.hit_ratio, r.hit_percent) == (0.0, 0.0)
    assert metrics.latency_of_means(empty).first().mean_of_means_us == 0.0


def test_slot_gaps_and_reorg(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (5, 4), (6, 3)], "slot long, parent_slot long")
    got = sorted(tuple(r) for r in changes.slot_gaps(df, rows=2).collect())
    assert got == [(5, 4, 2, 2, False, 0), (6, 3, 5, 0, True, 2)]


def test_new_signatures_partition(spark):
    cur = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "address string, signature string")
    seen = spark.createDataFrame([("a", "1")], "address string, signature string")
    new = ledger.new_signatures(cur, seen)
    assert sorted(map(tuple, new.union(seen).collect())) == sorted(map(tuple, cur.collect()))


def test_watchlist_edit_order(spark):
    watch = spark.createDataFrame([("a",), ("b",)], "address string")
    edits = spark.createDataFrame([("a", "remove", 1), ("c", "add", 2), ("c", "remove", 3), ("a", "add", 4)],
                                  "address string, op string, seq long")
    assert sorted(r.address for r in ledger.watchlist_edit(watch, edits).collect()) == ["a", "b"]


def test_content_id_matches_python_base32(spark):
    texts = ["hello", "", "ledger archive ✓"]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    got = [r.cid for r in df.select(content_id(F.col("payload")).alias("cid")).collect()]
    want = ["bafybeib" + base64.b32encode(hashlib.sha256(t.encode()).digest()[:20]).decode().rstrip("=")
            for t in texts]
    assert got == want


def test_archive_manifest_dedups_copies(spark):
    df = spark.createDataFrame([("x", "same", 1, False), ("y", "same", 2, True), ("z", "other", 3, False)],
                               "name string, payload string, uploaded_at long, pinned boolean")
    man = archive.manifest(df)
    assert man.count() == 2
    assert man.where("name = 'y'").first().pinned is True
    kept, removed = archive.cleanup(man, now_epoch=10 + 86400, days=1)
    assert removed.count() == 1 and kept.count() == 1


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz", 0, 5)], "a string, fee long, n long")
    r = df.select(short_address("a").alias("s"), short_address(F.lit("short")).alias("t"),
                  fee_text("fee").alias("f0"), fee_text(F.lit(5000)).alias("f1"),
                  saturating_sub("n", 7).alias("z")).first()
    assert (r.s, r.t, r.f0, r.f1, r.z) == ("abcdefgh...stuvwxyz", "short", "No fee", "0.000005000 SOL", 0)


def test_footprint_rollup_total(spark):
    df = spark.createDataFrame([("a", 10), ("a", 30), ("b", 2_000_000)], "kind string, bytes long")
    got = {r.kind: (r.entries, r.total_bytes, r.bytes_per_entry, r.total_mb) for r in metrics.footprint(df).collect()}
    assert got == {"a": (2, 40, 20.0, 0), "b": (1, 2_000_000, 2_000_000.0, 2), None: (3, 2_000_040, 666680.0, 2)}


def test_tx_by_program_list_and_table_agree(spark):
    tx = spark.createDataFrame([("s1", ["p1", "p2"]), ("s2", ["p3"]), ("s3", [])],
                               "signature string, program_ids array<string>")
    progs = spark.createDataFrame([("p2",), ("p3",), ("p2",)], "program_id string")
    by_list = sorted(r.signature for r in joins.tx_by_program(tx, ["p2", "p3"]).collect())
    by_table = sorted(r.signature for r in joins.tx_by_program(tx, progs).collect())
    assert by_list == by_table == ["s1", "s2"]


def test_json_array_and_enum_helpers(spark):
    from tallyframe.functions.expr import display_time, enum_or_unknown, json_string_array, name_or_default
    df = spark.createDataFrame([('["a","b"]', "send", None, dt.datetime(2024, 1, 2, 3, 4, 5))],
                               "j string, k string, n string, ts timestamp_ntz")
    r = df.select(json_string_array("j").alias("a"), json_string_array(F.lit("not json")).alias("b"),
                  enum_or_unknown("k", ["SEND", "RECEIVE"]).alias("k1"), enum_or_unknown(F.lit("x"), ["SEND"]).alias("k2"),
                  name_or_default("n").alias("n"), display_time("ts").alias("t1"),
                  display_time("ts", short=True).alias("t2")).first()
    assert (r.a, r.b, r.k1, r.k2, r.n, r.t1, r.t2) == (["a", "b"], [], "SEND", "UNKNOWN", "Unnamed",
                                                       "2024-01-02 03:04:05", "01-02 03:04:05")


def test_prefix_helper(spark):
    from tallyframe.functions.expr import prefix
    r = spark.createDataFrame([("abcdefghijkl",), ("ab",)], "s string").select(prefix("s", 8).alias("p")).collect()
    assert [x.p for x in r] == ["abcdefgh", "ab"]


def test_scale_conf_sizes_partitions():
    from tallyframe.session import scale_conf
    small = scale_conf(10 * 1024 * 1024, cores=8)
    big = scale_conf(100 * 1024 ** 4, cores=8000)
    assert small["spark.sql.shuffle.partitions"] == "16"
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 * 1024)
