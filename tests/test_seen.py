"""Stored filters of seen keys: exact results at every load, and what they keep out of the shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ledger, seen as seen_keys
from tallyframe.operators.seen import build_filter, maybe_seen, merge_filters, new_keys

KEYS = ["address", "signature"]
SCHEMA = "address string, signature string, ts long"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _snap(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _data(rng, n):
    rows = [(f"a{rng.randint(0, 40)}", f"s{rng.randint(0, 400)}", rng.randint(0, 99)) for _ in range(n)]
    return rows + rows[:5] + [(None, "s1", 3), ("a1", None, 4), (None, None, 5)]


@pytest.mark.parametrize("blocks", [1, 16, 1 << 12])
def test_new_keys_equal_the_anti_join_at_every_load(spark, blocks):
    rng = random.Random(blocks)
    cur, seen = _rows(spark, _data(rng, 600)), _rows(spark, _data(rng, 900))
    held = build_filter(seen, KEYS, F.floor(F.col("ts") / 10), blocks)
    assert _snap(new_keys(cur, seen, held, KEYS, blocks)) == _snap(ledger.new_signatures(cur, seen))


def test_new_keys_without_rows(spark):
    some, none = _rows(spark, [("a", "1", 1), ("a", "1", 1), (None, "1", 2)]), _rows(spark, [])
    for cur, seen in ((some, none), (none, some), (none, none)):
        held = build_filter(seen, KEYS, F.lit(0), 64)
        assert _snap(new_keys(cur, seen, held, KEYS, 64)) == _snap(ledger.new_signatures(cur, seen))


def test_a_filter_too_large_to_broadcast_is_joined(spark, monkeypatch):
    rng = random.Random(5)
    cur, seen = _rows(spark, _data(rng, 300)), _rows(spark, _data(rng, 300))
    held = build_filter(seen, KEYS, F.col("ts"), 256)
    monkeypatch.setattr(seen_keys, "LOOKUP_BYTES", 0)
    out = new_keys(cur, seen, held, KEYS, 256)
    assert _snap(out) == _snap(ledger.new_signatures(cur, seen))


def test_filters_of_parts_merge_to_the_filter_of_all(spark):
    seen = _rows(spark, _data(random.Random(7), 500))
    parts = [build_filter(seen.where(F.col("ts") % 3 == i), KEYS, F.floor(F.col("ts") / 25), 128) for i in range(3)]
    assert _snap(merge_filters(*parts)) == _snap(build_filter(seen, KEYS, F.floor(F.col("ts") / 25), 128))


def test_filter_is_bounded_and_lets_few_through(spark):
    blocks = 512
    seen = spark.range(blocks * 16).selectExpr("concat('a', id) AS address", "concat('s', id) AS signature", "0L AS ts")
    held = build_filter(seen, KEYS, F.col("ts"), blocks)
    assert held.count() <= blocks
    others = spark.range(20_000).selectExpr("concat('b', id) AS address", "concat('s', id) AS signature", "0L AS ts")
    assert maybe_seen(seen, held, KEYS, blocks).where("not _maybe").count() == 0
    assert maybe_seen(others, held, KEYS, blocks).where("_maybe").count() < 20_000 / 100


def test_look_up_does_not_shuffle_the_rows(spark):
    blocks = 64
    cur, seen = _rows(spark, _data(random.Random(9), 50)), _rows(spark, _data(random.Random(10), 50))
    df = maybe_seen(cur, build_filter(seen, KEYS, F.lit(0), blocks), KEYS, blocks)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(address" not in plan and "hashpartitioning(signature" not in plan
