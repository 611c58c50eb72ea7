"""Relations stored by slot: declared schemas, and joins and aggregates without a shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.operators import joins
from tallyframe.plans.fixtures import LedgerViews
from tallyframe.sources import layout
from tallyframe.sources.tables import Tables

from .conftest import SF_SMALL


def _views(spark):
    v = LedgerViews(Tables(spark, SF_SMALL))
    return ((v.transactions, schemas.TRANSACTIONS), (v.headers.withColumn("finalized", F.lit(True)), schemas.SLOTS), (v.slot_leaders, schemas.SLOT_LEADERS))


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _snap(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_enrichment_of_stored_relations_has_no_exchange(spark, tmp_path, no_broadcast):
    views = _views(spark)
    stored = [layout.store(df, f"{tmp_path}/{i}", schema, 4) for i, (df, schema) in enumerate(views)]
    out = joins.tx_enriched(*stored)
    plan = _plan(out)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    plain = joins.tx_enriched(*(layout.conform(df, schema) for df, schema in views))
    assert "Exchange" in _plan(plain)
    assert _snap(out) == _snap(plain)


def test_totals_by_slot_have_no_exchange(spark, tmp_path):
    df, schema = _views(spark)[0]
    totals = layout.store(df, f"{tmp_path}/tx", schema, 4).groupBy("slot").agg(F.count("*").alias("n"), F.sum("fee").alias("fees"))
    assert "Exchange" not in _plan(totals)
    assert _snap(totals) == _snap(df.groupBy("slot").agg(F.count("*").alias("n"), F.sum("fee").alias("fees")))


def test_opened_again_with_declared_schema(spark, tmp_path, no_broadcast):
    views = _views(spark)
    for i, (df, schema) in enumerate(views):
        layout.store(df, f"{tmp_path}/{i}", schema, 3)
    again = [layout.opened(spark, f"{tmp_path}/{i}", schema, 3) for i, (_, schema) in enumerate(views)]
    assert [d.columns for d in again] == [s.names for _, s in views]
    out = joins.tx_enriched(*again)
    assert "Exchange" not in _plan(out)
    assert _snap(out) == _snap(joins.tx_enriched(*(layout.conform(df, schema) for df, schema in views)))


def test_rows_are_held_to_the_schema(spark, tmp_path):
    leaders = schemas.SLOT_LEADERS
    with pytest.raises(ValueError, match="leader_pubkey"):
        layout.conform(spark.createDataFrame([(1,)], "slot long"), leaders)
    with pytest.raises(Exception, match="a null slot"):
        layout.store(spark.createDataFrame([(None, "x")], "slot long, leader_pubkey string"), f"{tmp_path}/null", leaders, 2)
    got = layout.conform(spark.createDataFrame([("x", 7, 1)], "leader_pubkey string, slot int, extra int"), leaders)
    assert [tuple(r) for r in got.collect()] == [(7, "x")] and got.schema["slot"].dataType == leaders["slot"].dataType
    empty = layout.store(spark.createDataFrame([], leaders), f"{tmp_path}/empty", leaders, 2)
    assert empty.count() == 0 and empty.columns == leaders.names


def test_repeated_slots_and_missing_partners(spark, tmp_path, no_broadcast):
    t = dt.datetime(2024, 1, 1)
    tx = spark.createDataFrame([("a", 1, t), ("b", 1, t), ("c", 9, t), ("d", None, t)], "signature string, slot long, ts timestamp_ntz")
    for c, kind in (("fee", "long"), ("status", "string"), ("program_id", "string"), ("payer", "string"), ("amount", "double")):
        tx = tx.withColumn(c, F.lit(None).cast(kind))
    slots = spark.createDataFrame([(1, "h", 0, True, t)], schemas.SLOTS)
    leaders = spark.createDataFrame([(1, "l"), (2, "m")], schemas.SLOT_LEADERS)
    stored = [layout.store(df, f"{tmp_path}/{i}", s, 2) for i, (df, s) in enumerate(((tx, schemas.TRANSACTIONS), (slots, schemas.SLOTS), (leaders, schemas.SLOT_LEADERS)))]
    got = {r.signature: (r.slot, r.blockhash, r.leader_pubkey) for r in joins.tx_enriched(*stored).collect()}
    assert got == {"a": (1, "h", "l"), "b": (1, "h", "l"), "c": (9, None, None), "d": (None, None, None)}


def test_bucket_count_follows_the_volume():
    assert layout.buckets_for(10, cores=4) == 4
    assert layout.buckets_for(100 * 1024 ** 4) == 100 * 1024 ** 4 // layout.BUCKET_BYTES
