"""Ledger-shaped views over the driver tables (FIXTURES.md §3), as DataFrames.

The SQL text of the same views lives in ``plans/registry.py``; the oracle check
compares the two, so any drift shows up as a mismatch.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.sources.tables import Tables


def _addr(c) -> Column:
    return F.concat(F.lit("acct"), F.lpad(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), 8, "0"))


def _sig(c: str = "event_id") -> Column:
    return F.concat(F.lit("sig"), F.lpad(F.col(c).cast("string"), 10, "0"))


def _slot_of(c: str = "event_id") -> Column:
    return F.floor(F.col(c) / 10).cast("long")


def _props_n() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("long")


class LedgerViews:
    """Views of one scale-factor folder, built lazily and shared per call."""

    def __init__(self, tables: Tables):
        self.t = tables

    @cached_property
    def transactions(self) -> DataFrame:
        ev = self.t.events
        return ev.select(
            _sig().alias("signature"),
            _slot_of().alias("slot"),
            (F.lit(5000) + F.col("event_id") % 10000).alias("fee"),
            F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
            F.concat(F.lit("prog"), (_props_n() % 7).cast("string")).alias("program_id"),
            _addr("user_id").alias("payer"),
            F.col("value").alias("amount"),
            "ts")

    @cached_property
    def slots(self) -> DataFrame:
        tx = self.transactions
        tip = tx.select(F.max("slot")).scalar()
        per_slot = tx.groupBy("slot").agg(F.min("ts").alias("ts"), F.count("*").alias("tx_count"))
        return per_slot.select(
            "slot",
            F.concat(F.lit("bh"), F.lpad(F.col("slot").cast("string"), 8, "0")).alias("blockhash"),
            F.greatest(F.col("slot") - 1, F.lit(0)).alias("parent_slot"),
            (F.col("slot") < F.greatest(tip - 31, F.lit(0))).alias("finalized"),
            "ts", "tx_count")

    @cached_property
    def headers(self) -> DataFrame:
        return self.slots.where(F.col("slot") % 7 != 0).select(
            "slot", "blockhash", "parent_slot", "ts", "tx_count")

    @cached_property
    def slot_leaders(self) -> DataFrame:
        sup = self.t.supplier
        n_sup = sup.select(F.count(F.lit(1))).scalar()
        sched = self.slots.select("slot", (F.floor(F.col("slot") / 4).cast("long") % n_sup).alias("_k"))
        return (sched.join(sup.select("s_suppkey", "s_name"), F.col("_k") == F.col("s_suppkey"))
                .select("slot", F.col("s_name").alias("leader_pubkey")))

    @cached_property
    def tracked(self) -> DataFrame:
        return self.t.customer.select(
            F.col("c_custkey").alias("id"), _addr("c_custkey").alias("address"),
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tag"),
            (F.col("c_acctbal") >= 0).alias("is_active"))

    @cached_property
    def snapshots(self) -> DataFrame:
        n = _props_n()
        return self.t.events.select(
            F.col("event_id").alias("id"), _addr("user_id").alias("account_address"),
            (F.round(F.col("value") * 100).cast("long") * 10000000).alias("lamports"),
            n.alias("data_size"), F.col("event_type").alias("owner"),
            (F.col("event_type") == "signup").alias("executable"),
            F.floor(n / 10).cast("long").alias("rent_epoch"),
            _slot_of().alias("slot"), "ts")

    @cached_property
    def tx_accounts(self) -> DataFrame:
        tx = self.transactions
        third = (self.t.events.where(F.col("event_type") != "view")
                 .select(_sig().alias("signature"), F.lit(2).alias("pos"),
                         _addr(F.col("user_id") + 1).alias("account")))
        return (tx.select("signature", F.lit(0).alias("pos"), F.col("payer").alias("account"))
                .unionByName(tx.select("signature", F.lit(1).alias("pos"), F.col("program_id").alias("account")))
                .unionByName(third))

    @cached_property
    def pushed_transactions(self) -> DataFrame:
        """Transactions as a node pushes them, each with its own account list (``tx_accounts`` gathered by signature)."""
        ev = self.t.events
        third = F.when(F.col("event_type") != "view", F.array(_addr(F.col("user_id") + 1))).otherwise(F.array().cast("array<string>"))
        program = F.concat(F.lit("prog"), (_props_n() % 7).cast("string"))
        failed = F.col("event_type") == "error"
        return ev.select(_sig().alias("signature"), _slot_of().alias("slot"), (F.lit(5000) + F.col("event_id") % 10000).alias("fee"),
                         F.when(failed, "failed").otherwise("success").alias("status"), program.alias("program_id"),
                         F.concat(F.array(_addr("user_id"), program), third).alias("account_keys"),
                         (program == "prog0").alias("is_vote"), failed.alias("failed"))

    @cached_property
    def activities(self) -> DataFrame:
        et = F.col("event_type")
        return self.t.events.select(
            F.col("event_id").alias("id"), _addr("user_id").alias("wallet_address"),
            F.when(et == "view", "UNKNOWN").when(et == "signup", "RECEIVE").otherwise("SEND").alias("activity_type"),
            _sig().alias("transaction_signature"), _slot_of().alias("block_slot"),
            (F.lit(5000) + F.col("event_id") % 10000).alias("fee"),
            F.when(et == "error", "failed").otherwise("success").alias("status"),
            F.col("value").alias("amount"), "ts")

    @cached_property
    def balances(self) -> DataFrame:
        m = F.col("event_id") % 3
        return self.t.events.select(
            F.col("event_id").alias("id"), _addr("user_id").alias("wallet_address"),
            F.when(m == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("mint"), m.cast("string")))
            .alias("token_mint"),
            F.col("value").alias("balance"), _slot_of().alias("slot"), "ts")

    @cached_property
    def labels(self) -> DataFrame:
        c = self.t.customer
        custom = c.select(F.col("c_custkey").alias("id"), _addr("c_custkey").alias("address"),
                          F.col("c_mktsegment").alias("label"), F.lit("custom").alias("label_type"),
                          ((F.col("c_custkey") % 10).cast("double") / 10).alias("confidence"))
        exch = (c.where(F.col("c_nationkey") % 2 == 0)
                .select((F.col("c_custkey") + 1000000).alias("id"), _addr("c_custkey").alias("address"),
                        F.lit("exchange").alias("label"), F.lit("exchange").alias("label_type"),
                        F.lit(0.5).cast("double").alias("confidence")))
        return custom.unionByName(exch)

    @cached_property
    def access_log(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("request_id"), F.col("event_type").alias("kind"),
            (F.col("value") < 40).alias("hit"),
            F.round(F.col("value") * 10).cast("long").alias("response_us"),
            _props_n().alias("bytes"), "ts")

    @cached_property
    def archive(self) -> DataFrame:
        return self.t.documents.select(
            "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
            F.col("text").alias("payload"), F.col("n_chars").alias("size"),
            (F.lit(1700000000) + F.col("doc_id") * 3600).alias("uploaded_at"),
            (F.col("doc_id") % 5 == 0).alias("pinned"))
