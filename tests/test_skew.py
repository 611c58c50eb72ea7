"""A key holding a third of all rows: the chunked flagship stays exact and its window groups stay bounded."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import changes, sequence
from tallyframe.operators.sequence import CHUNK, with_chunk

N = 30_000
T0 = dt.datetime(2024, 1, 1)


def _snapshots():
    rng = np.random.default_rng(7)
    ids = np.arange(N)
    hot = ids % 3 == 0
    acct = np.where(hot, "hot", np.char.add("a", (rng.integers(0, 500, N)).astype(str)))
    return pd.DataFrame({
        "id": ids, "account_address": acct, "lamports": rng.integers(0, 4, N) * 1000,
        "data_size": rng.integers(0, 3, N), "owner": rng.choice(["x", "y"], N), "executable": rng.random(N) < 0.05,
        "rent_epoch": rng.integers(0, 2, N), "slot": ids // 5,
        "ts": [T0 + dt.timedelta(milliseconds=int(i) * 400) for i in ids]})


def _bruteforce(pdf):
    out = []
    for acct, g in pdf.sort_values(["slot", "ts", "id"]).groupby("account_address"):
        prev = None
        for r in g.itertuples():
            if prev is not None:
                for kind, f in (("BALANCE_CHANGE", "lamports"), ("DATA_CHANGE", "data_size"), ("OWNER_CHANGE", "owner"),
                                ("EXECUTABLE_CHANGE", "executable"), ("RENT_EPOCH_CHANGE", "rent_epoch")):
                    if getattr(prev, f) != getattr(r, f):
                        out.append((acct, r.id, kind))
            prev = r
    return sorted(out)


@pytest.mark.parametrize("rows", [100, 1 << 20])
def test_hot_key_changes_exact_and_bounded(spark, rows):
    pdf = _snapshots()
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = changes.account_changes(df, rows=rows)
    assert sorted((r.account_address, r.snapshot_id, r.activity_type) for r in got.collect()) == _bruteforce(pdf)
    # the largest window group holds about ``rows`` rows, not the 10k of the hot key
    biggest = with_chunk(df, ["account_address"], ["slot", "ts", "id"], rows).groupBy("account_address", CHUNK).count().agg(F.max("count")).first()[0]
    hot_rows = int((pdf["account_address"] == "hot").sum())
    assert biggest <= min(hot_rows, 2 * rows)


BURST, OUTLIER, EQUAL = "burst", "outlier", "equal times"


def _uneven(kind):
    """Rows whose times say little about how many rows there are: a hot minute beside a year, one early row, one time for all."""
    if kind == BURST:
        return [("hot", i % 60, i) for i in range(6000)] + [("slow", i * 86_400, i) for i in range(365)]
    if kind == OUTLIER:
        return [("k", 0, 0)] + [("k", 10 ** 9 + i, i) for i in range(1, 6000)]
    return [("k", 5, i) for i in range(6000)] + [(None, None, i) for i in range(50)]


@pytest.mark.parametrize("kind", [BURST, OUTLIER, EQUAL])
def test_chunks_are_bounded_whatever_the_times(spark, kind):
    rows = _uneven(kind)
    df = spark.createDataFrame(rows, "k string, t long, id long")
    biggest = with_chunk(df, ["k"], ["t", "id"], 100).groupBy(CHUNK).count().agg(F.max("count")).first()[0]
    assert biggest <= 100
    order = sorted(rows, key=lambda r: (r[0] or "", r[0] is not None, -1 if r[1] is None else r[1], r[2]))
    before, place, total = {}, {}, {}
    for at, r in enumerate(order):
        same = at > 0 and order[at - 1][0] == r[0]
        before[r] = order[at - 1][2] if same else None
        place[r] = place[order[at - 1]] + 1 if same else 1
        total[r] = (total[order[at - 1]] if same else 0) + r[2]
    key = lambda r: (r.k, r.t, r.id)
    assert {key(r): r.p for r in sequence.with_previous(df, ["k"], ["t", "id"], ["id"], rows=100).select("*", F.col("prev.id").alias("p")).collect()} == before
    assert {key(r): r.ordinal for r in sequence.with_ordinal(df, ["k"], ["t", "id"], rows=100).collect()} == place
    assert {key(r): r.running_total for r in sequence.with_running_total(df, ["k"], ["t", "id"], "id", rows=100).collect()} == total
    mean = {key(r): r.running_mean for r in sequence.with_running_mean(df, ["k"], ["t", "id"], "id", rows=100).collect()}
    assert all(abs(mean[r] - total[r] / place[r]) < 1e-6 for r in rows)


def test_sequences_of_no_rows(spark):
    none = spark.createDataFrame([], "k string, t long, id long")
    assert sequence.with_previous(none, ["k"], ["t"], ["id"]).collect() == sequence.with_ordinal(none, [], ["t"]).collect() == []


def test_values_need_not_follow_the_order(spark):
    """The chunk follows the order, not the value: 0, 300, 0 are three values, and reports may go back."""
    df = spark.createDataFrame([(1, 0), (2, 300), (3, 0), (4, 0)], "seq long, v long")
    assert sorted(r.seq for r in changes.distinct_until_changed(df, "v", ["seq"], rows=1).collect()) == [1, 2, 3]
    rows = [("a", i, s, s) for i, s in enumerate([100, 600, 101, 601])]
    reports = spark.createDataFrame(rows, "source string, seq long, slot long, finalized_slot long")
    got = changes.slot_progress(reports, order=("seq",), rows=1).orderBy("seq").collect()
    assert [(r.slot, r.slot_delta) for r in got] == [(100, 1), (600, 500), (601, 500)]
