"""Batch = stream, across several micro-batches and a checkpoint restart."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F

from tallyframe.operators import changes, metrics
from tallyframe.session import scratch_path
from tallyframe.streaming import streams

SNAP = "id long, account_address string, lamports long, data_size long, owner string, executable boolean, " \
       "rent_epoch long, slot long, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def _rows(lo, hi):
    out = []
    for i in range(lo, hi):
        acct = "hot" if i % 3 else f"a{i % 4}"
        out.append((i, acct, (i * 37) % 11 * 1000, i % 4, "o" if i % 5 else "p", i % 7 == 0, i // 10, i,
                    T0 + dt.timedelta(seconds=i)))
    return out


def _key(df):
    return sorted(tuple(r) for r in df.select("account_address", "snapshot_id", "activity_type", "old_value",
                                               "new_value", "lamports_change", "data_size_change").collect())


def _land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _changes(spark, land, out, ckpt, schema):
    """Drain what has landed; the changes and the rejected rows so far."""
    src = streams.read_stream(spark, land, schema)
    q = streams.start_batches(src.select(*streams.SNAPSHOT_COLS), streams.account_change_batches(out), ckpt)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/out"), spark.read.parquet(f"{out}/rejects")


def test_account_change_stream_equals_batch_across_restart(spark, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    land, out, ckpt = (scratch_path(spark, n) for n in ("t-land", "t-out", "t-ckpt"))
    schema = spark.createDataFrame([], SNAP).schema
    for lo, hi in ((0, 40), (40, 80)):
        _land(spark, _rows(lo, hi), SNAP, land)
    _changes(spark, land, out, ckpt, schema)
    for lo, hi in ((80, 100), (100, 120)):
        _land(spark, _rows(lo, hi), SNAP, land)
    got, rejects = _changes(spark, land, out, ckpt, schema)  # restart from the checkpoint and the stored states
    batch = changes.account_changes(spark.createDataFrame(_rows(0, 120), SNAP), rows=16)
    assert _key(got) == _key(batch)
    assert rejects.count() == 0


def test_large_numbers_nulls_and_late_rows(spark):
    """Balances beyond 2**53 stay exact beside a null, and a late state is rejected, not lost."""
    land, out, ckpt = (scratch_path(spark, n) for n in ("t-big", "t-bigout", "t-bigckpt"))
    big = 2 ** 53

    def row(i, slot, lamports):
        return (i, "a", lamports, 1, "o", False, 1, slot, T0 + dt.timedelta(seconds=slot))

    first, second = [row(0, 1, big), row(1, 3, big + 1)], [row(2, 2, 7), row(3, 4, None), row(4, 5, big + 3)]
    for rows in (first, second):
        _land(spark, rows, SNAP, land)
    got, rejects = _changes(spark, land, out, ckpt, spark.createDataFrame([], SNAP).schema)
    in_time = [r for r in first + second if r[0] != 2]
    assert _key(got) == _key(changes.account_changes(spark.createDataFrame(in_time, SNAP)))
    assert [r.id for r in rejects.collect()] == [2]
    assert f"{big + 3} lamports" in {r.new_value for r in got.collect()}


def test_slot_stream_and_dedup(spark):
    land = scratch_path(spark, "t-slots")
    rows = [(f"s{i:03d}", i // 3, T0 + dt.timedelta(seconds=i)) for i in range(30)]
    schema = "signature string, slot long, ts timestamp_ntz"
    for lo in (0, 10, 20):
        _land(spark, rows[lo:lo + 10], schema, land)
    src = streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)
    got = streams.run_slot_changes(spark, src, "t-slot-out")
    assert sorted(r.slot for r in got.collect()) == list(range(10))
    dsrc = streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)
    dd = streams.run_available_now(streams.new_signature_stream(dsrc.select(F.col("slot").cast("string")
                                                                           .alias("address"), "signature")),
                                   spark, "t-dedup")
    assert dd.count() == 30


def _run(spark, files, schema, job, name, processing_time=None):
    """The folders of a job that takes each list of rows as one micro-batch."""
    land = scratch_path(spark, name)
    for i, rows in enumerate(files):
        _land(spark, rows, schema, land)
        for f in Path(land).glob("*.parquet"):
            if not f.name.startswith("f"):
                f.rename(f.with_name(f"f{i:03d}.parquet"))
                os.utime(f.with_name(f"f{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
        for f in Path(land).glob(".*.crc"):
            f.unlink()
    src = streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)
    return streams.run_batches(spark, src, job, name, processing_time)


def test_rate_stream_equals_its_batch_twin(spark):
    schema = "id long, k string, v long, ts timestamp_ntz"
    rows = [(i, f"k{i % 3}", i, T0 + dt.timedelta(minutes=7 * i)) for i in range(60)]
    want = {r.window_start: r.n for r in metrics.batch_rate(spark.createDataFrame(rows, schema)).collect() if r.window_end <= rows[-1][3] - dt.timedelta(hours=1)}
    path = _run(spark, [rows[:30], rows[30:]], schema, streams.batch_rate_batches, "t-rate", processing_time="1 second")
    assert {r.window_start: r.n for r in spark.read.parquet(f"{path}/out").collect()} == want
    land = scratch_path(spark, "t-rate-wm")
    _land(spark, rows, schema, land)
    got = streams.run_available_now(streams.batch_rate_stream(streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)), spark, "t-rate-out").collect()
    assert {r.window_start.replace(tzinfo=None): r.n for r in got} == want


def test_late_rows_of_the_rate_go_to_rejects(spark):
    """Rows out and still open plus rejects are the rows in, over files out of order."""
    schema = "id long, k string, ts timestamp_ntz"
    early = [(i, "a", T0 + dt.timedelta(minutes=10 * i)) for i in range(30)]
    late = [(100 + i, "b", T0 + dt.timedelta(minutes=20 * i)) for i in range(15)] + [(200, None, None)]
    path = _run(spark, [early, late, [(300, "a", T0 + dt.timedelta(hours=9))]], schema, lambda p: streams.batch_rate_batches(p, by=("k",)), "t-late")
    out, state = spark.read.parquet(f"{path}/out").collect(), spark.read.parquet(f"{path}/state").where("batch_id = 2").collect()
    rejects = {r.id for r in spark.read.parquet(f"{path}/rejects").collect()}
    clock = early[-1][2] - dt.timedelta(hours=1)
    assert rejects == {i for i, _, t in late if t is not None and t.replace(minute=0) + dt.timedelta(hours=1) <= clock}
    assert sum(r.n for r in out) + sum(r.n for r in state) + len(rejects) == len(early) + len([r for r in late if r[2]]) + 1
    assert len({(r.window_start, r.k) for r in out}) == len(out)


def test_late_sightings_go_to_rejects(spark):
    schema = "address string, signature string, ts timestamp_ntz"
    hour = dt.timedelta(hours=1)
    first = [("a", "s1", T0), ("a", "s1", T0 + hour), ("a", "s2", T0 + 30 * hour)]
    second = [("a", "s1", T0 + 2 * hour), ("a", "s2", T0 + 20 * hour), ("a", "s3", T0 + 29 * hour), ("a", "s3", T0 + 40 * hour)]
    path = _run(spark, [first, second], schema, lambda p: streams.new_signature_batches(p, delay="1 day"), "t-seen")
    out = sorted((r.signature, r.ts) for r in spark.read.parquet(f"{path}/out").collect())
    assert out == [("s1", T0), ("s2", T0 + 30 * hour), ("s3", T0 + 29 * hour)]
    assert [tuple(r)[:3] for r in spark.read.parquet(f"{path}/rejects").collect()] == [second[0]]


def test_last_signatures_follow_the_polls(spark, monkeypatch):
    """What is new on a list of the last 3: a first poll whole, nothing that stood on it, and again what had left it."""
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    schema = "address string, signature string, ts timestamp_ntz"

    def row(a, s, t):
        return (a, s, T0 + dt.timedelta(days=t))

    polls = [[row("a", f"s{i}", i) for i in range(5)] + [row(None, "n", 0)], [row("a", "s4", 5), row("a", "s5", 6)], [row("b", "x", 1), row(None, "n", 0)], [row("a", "s2", 7), row("a", "s6", 8)], [row("b", "x", 1)]]
    path = _run(spark, polls, schema, lambda p: streams.recent_signature_batches(p, keep=3), "t-last")
    got = sorted((r.batch_id, str(r.address), r.signature) for r in spark.read.parquet(f"{path}/out").collect())
    last, want = {}, []
    for n, poll in enumerate(polls):
        for a in {r[0] for r in poll}:
            at = {s: t for s, t in last.get(a, [])}
            for r in poll:
                if r[0] == a:
                    at[r[1]] = max(at.get(r[1], r[2]), r[2])
            now = sorted(at.items(), key=lambda x: (x[1], x[0]))[-3:]
            want += [(n, str(a), s) for s, _ in now if s not in dict(last.get(a, []))]
            last[a] = now
    assert got == sorted(want)
    assert (3, "a", "s2") in got


def test_states_live_since_they_were_written_and_touched(spark, monkeypatch):
    """A state lives its whole time whatever the window it was written in; reads keep it from idling, and do not revive it."""
    monkeypatch.setattr(streams, "COMPACT_EVERY", 2)
    schema = "id long, k string, v long, ts timestamp_ntz, read boolean"

    def row(i, k, v, s, read=False):
        return (i, k, v, T0 + dt.timedelta(seconds=s), read)

    files = [[row(1, "edge", 1, 599), row(2, "idle", 2, 0), row(3, "read", 3, 0), row(4, "revived", 4, 0), row(5, "old", 5, 0)],
             [row(6, "read", None, 100, True), row(7, "revived", None, 130, True), row(8, "unknown", None, 5, True)],
             [row(9, "read", None, 200, True), row(10, "old", 6, 10), row(11, "read", None, 300, True)], [row(12, "edge", None, 600, True)]]
    columns = ["v"]
    path = _run(spark, files, schema, lambda p: streams.fresh_state_batches(p, "k", columns, "600 seconds", "120 seconds", read="read"), "t-ttl")

    def alive(s, idle="120 seconds"):
        now = F.lit(T0 + dt.timedelta(seconds=s)).cast("timestamp_ntz")
        return {r.k: r.v for r in streams.fresh(spark, path, spark.createDataFrame([], schema).schema, "k", columns, now, "600 seconds", idle).collect()}

    assert alive(400) == {"edge": 1, "read": 3}
    assert alive(421) == {"edge": 1}
    assert alive(720) == {"edge": 1} and alive(721) == {}
    assert "edge" in alive(1199, None) and "edge" not in alive(1200, None)


def test_signature_dedup_within_watermark(spark):
    land = scratch_path(spark, "t-wm")
    schema = "address string, signature string, ts timestamp_ntz"
    rows = [("a", "s1", T0), ("a", "s1", T0 + dt.timedelta(seconds=5)), ("a", "s2", T0 + dt.timedelta(seconds=6))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(land)
    src = streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)
    got = streams.run_available_now(streams.new_signature_stream(src, watermark="1 hour"), spark, "t-wm-out")
    assert sorted(r.signature for r in got.collect()) == ["s1", "s2"]


def test_idempotent_batch_writer_replaces_retried_batch(spark):
    out = scratch_path(spark, "t-k3")
    write = streams.idempotent_batch_writer(out)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    write(df, 0)
    write(df, 0)  # a retry of batch 0 must not duplicate
    write(df.limit(1), 1)
    got = spark.read.parquet(out)
    assert got.count() == 3 and sorted(r.batch_id for r in got.select("batch_id").distinct().collect()) == [0, 1]


def test_foreach_batch_stream_equals_file_sink(spark):
    land, out, ckpt = (scratch_path(spark, n) for n in ("t-fb-land", "t-fb-out", "t-fb-ckpt"))
    schema = "address string, signature string"
    for lo in (0, 5):
        spark.createDataFrame([(f"a{i % 2}", f"s{i}") for i in range(lo, lo + 5)], schema) \
            .coalesce(1).write.mode("append").parquet(land)
    src = streams.read_stream(spark, land, spark.createDataFrame([], schema).schema)
    q = (streams.new_signature_stream(src).writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(streams.idempotent_batch_writer(out)).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 10
