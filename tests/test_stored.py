"""Stored tables kept by ranges, rejects of JSON lines, latency histograms that merge, rollups of active days."""

import datetime as dt
import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import analytics, metrics
from tallyframe.operators.stored import RangeTable
from tallyframe.sources import ingest

BATCH = "slot long, v string, ingest_seq long"


def _table(spark, path, width=100):
    schema = spark.createDataFrame([], "slot long, v string").schema
    return RangeTable(spark, str(path / "ranges"), schema, width=width)


def _rows(table, **limits):
    return {r.slot: r.v for r in table.read(**limits).collect()}


def test_a_batch_rewrites_only_its_ranges(spark, tmp_path):
    t = _table(spark, tmp_path)
    assert _rows(t) == {} and t.batches() == []
    assert t.upsert(spark.createDataFrame([(s, "a", 0) for s in range(-50, 1000)], BATCH), 0) == list(range(-1, 10))
    small = spark.createDataFrame([(s, "b", q) for s in range(300, 400) for q in (0, 1)] + [(399, "c", 5)], BATCH)
    assert t.upsert(small, 1) == [3]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{t.path}/rows/batch=1/range=*")) == ["range=3"]
    want = {s: "c" if s == 399 else "b" if 300 <= s < 400 else "a" for s in range(-50, 1000)}
    assert _rows(t) == want
    assert t.upsert(small, 1) == [3] and _rows(t) == want  # a retry
    assert _rows(t, low=395, high=401) == {s: want[s] for s in range(395, 402)}
    files = t.read(low=395, high=401).inputFiles()
    assert {f.split("range=")[1].split("/")[0] for f in files} == {"3", "4"}


def test_an_unpublished_batch_is_not_seen(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, "a", 0), (150, "a", 0)], BATCH), 0)
    t.upsert(spark.createDataFrame([(1, "b", 0)], BATCH), 1)
    os.remove(f"{t.path}/versions/batch=1/_SUCCESS")  # the writer was lost before the end
    assert _rows(t) == {1: "a", 150: "a"}
    t.upsert(spark.createDataFrame([(1, "b", 0)], BATCH), 1)
    assert _rows(t) == {1: "b", 150: "a"}


def test_empty_batches_late_batches_and_null_keys(spark, tmp_path):
    t = _table(spark, tmp_path)
    none = spark.createDataFrame([], BATCH)
    assert t.upsert(none, 0) == [] and _rows(t) == {}
    t.upsert(spark.createDataFrame([(0, None, 0)], BATCH), 3)
    assert t.upsert(none, 4) == [] and _rows(t) == {0: None}
    with pytest.raises(ValueError, match="later"):
        t.upsert(none, 2)
    with pytest.raises(Exception, match="null slot"):
        t.upsert(spark.createDataFrame([(None, "x", 0)], BATCH), 5)
    assert _rows(t) == {0: None}
    with pytest.raises(ValueError, match="range"):
        RangeTable(spark, t.path, spark.createDataFrame([], "slot long, range long").schema)


def test_vacuum_keeps_what_the_newest_versions_name(spark, tmp_path):
    t, rnd, want = _table(spark, tmp_path, width=10), random.Random(3), {}
    for b in range(5):
        rows = [(rnd.randrange(60), f"{b}.{i}", i) for i in range(12)]
        want |= {s: v for s, v, _ in rows}
        t.upsert(spark.createDataFrame(rows, BATCH), b)
        assert _rows(t) == want
    before = len(glob.glob(f"{t.path}/rows/*/range=*"))
    gone = t.vacuum(keep=1)
    assert gone > 0 and len(glob.glob(f"{t.path}/rows/*/range=*")) == before - gone == len(t.versions())
    assert _rows(t) == want and t.batches() == [4]


def test_broken_lines_are_rejected(spark, tmp_path):
    good = '{"signature":"s1","slot":5,"fee":7,"status":"success","programIds":["p"],"timestamp":"2024-01-01T00:00:01.5Z"}'
    lines = {good: None, "": "blank", "   ": "blank", good[:40]: "malformed", "[1, 2]": "malformed", "not json": "malformed",
             good.replace('"s1"', "null"): "signature", good.replace(":5", ':"x"'): "malformed", good.replace('"slot":5,', ""): "slot",
             good.replace("2024-01-01T", "2024-13-01T"): "timestamp", good.replace("00:00:01.5Z", "late"): "timestamp",
             good.replace('"2024-01-01T00:00:01.5Z"', "null").replace("s1", "s2"): None}
    path = str(tmp_path / "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rows, rejects = ingest.read_tx_jsonl_checked(spark, path)
    assert sorted((r.signature, r.slot, r.program_ids, r.ts) for r in rows.collect()) == [
        ("s1", 5, ["p"], dt.datetime(2024, 1, 1, 0, 0, 1, 500000)), ("s2", 5, ["p"], None)]
    assert {r.line: r.reason for r in rejects.collect()} == {x: why for x, why in lines.items() if why not in (None, "blank")}
    none = str(tmp_path / "none")
    spark.createDataFrame([], "value string").write.text(none)
    assert all(df.count() == 0 for df in ingest.read_tx_jsonl_checked(spark, none))


def test_histograms_merge_to_the_percentiles_within_their_error(spark):
    rnd = np.random.default_rng(2)
    day = dt.datetime(2024, 1, 1)
    rows = [(k, int(x), day + dt.timedelta(minutes=int(m))) for k in ("a", "b", None) for x, m in
            zip(rnd.lognormal(8, 3, 400), rnd.integers(0, 2880, 400), strict=True)] + [("a", None, day), ("z", 0, day), ("z", 2**62, day)]
    log = spark.createDataFrame(rows, "kind string, response_us long, ts timestamp_ntz")
    stored = metrics.latency_histogram(log)
    whole = {r.kind: r for r in metrics.histogram_percentiles(stored, ["kind"]).collect()}
    assert set(whole) == {"a", "b", "z", None}
    for kind, r in whole.items():
        x = sorted(v for k, v, _ in rows if k == kind and v is not None)
        assert (r.n, r.min_us, r.max_us) == (len(x), x[0], x[-1])
        for p, got in ((0.5, r.p50_us), (0.95, r.p95_us), (0.99, r.p99_us)):
            exact = x[int(np.ceil(p * len(x))) - 1]
            assert abs(got - exact) <= exact / 128
    half = metrics.histogram_percentiles(stored.where(F.col("hour") < "2024-01-02"), ["kind"])
    direct = metrics.histogram_percentiles(metrics.latency_histogram(log.where(F.col("ts") < "2024-01-02")), ["kind"])
    assert sorted(map(str, half.collect())) == sorted(map(str, direct.collect()))
    merged = metrics.merge_histograms([stored, stored.limit(0), stored])
    assert {r.kind: r.n for r in metrics.histogram_percentiles(merged, ["kind"]).collect()} == {k: 2 * r.n for k, r in whole.items()}


def test_analytics_from_days_equal_those_from_the_log(spark):
    rnd = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    rows = [(w, rnd.choice(["SEND", None]), rnd.randrange(50), day + dt.timedelta(minutes=rnd.choice([0, 720, 1439, rnd.randrange(1440)]), days=rnd.randrange(12)))
            for w in ("a", "b", None) for _ in range(150)]
    log = spark.createDataFrame(rows, "wallet_address string, activity_type string, fee long, ts timestamp_ntz")
    stored = analytics.activity_days(log)
    for asof in ("2024-01-08 00:00:00", "2024-01-08 12:00:00", "2024-01-08 23:59:00"):
        for days in (0, 1, 5, 40):
            got, want = analytics.wallet_analytics_from_days(stored, log, asof, days), analytics.wallet_analytics(log, asof, days)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), (asof, days)
