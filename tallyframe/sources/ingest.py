"""Landed-record ingest: JSON lines, block headers, leader schedules, raw transactions,
second-chain documents. The network pulls of the reference are not built; these
normalise records a connector has already landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.base58 import base58_encode
from tallyframe.functions.expr import UNKNOWN_BLOCKHASH, ntz_from_micros
from tallyframe.schemas import FLOW_BLOCK_DOC, TX_JSONL

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'"
ISO_PATTERN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$"


def read_tx_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines transaction log -> typed rows (programIds -> program_ids, timestamp -> ts)."""
    raw = spark.read.schema(TX_JSONL).json(path)
    return raw.select("signature", "slot", "fee", "status", F.col("programIds").alias("program_ids"),
                      F.to_timestamp_ntz(F.col("timestamp"), F.lit(ISO_UTC)).alias("ts"))


def read_tx_jsonl_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S2 for logs with broken lines: (typed rows as ``read_tx_jsonl`` gives them, rejects with ``line`` and ``reason``).

    Every line that is not blank is in exactly one of the two. Reasons: ``malformed`` (no JSON object, or a field of the
    wrong type), ``signature`` or ``slot`` (missing), ``timestamp`` (given, but no ISO time in UTC).
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    spec = T.StructType([*TX_JSONL.fields, T.StructField("_broken", T.StringType())])
    r = F.col("r")
    time = F.when(r["timestamp"].rlike(ISO_PATTERN), F.regexp_replace(r["timestamp"], "Z$", "").try_cast("timestamp_ntz"))
    reason = (F.when(r.isNull() | r["_broken"].isNotNull(), "malformed").when(r["signature"].isNull(), "signature")
              .when(r["slot"].isNull(), "slot").when(r["timestamp"].isNotNull() & time.isNull(), "timestamp"))
    parsed = lines.select("value", F.from_json("value", spec, {"columnNameOfCorruptRecord": "_broken"}).alias("r"))
    parsed = parsed.select("value", "r", time.alias("ts"), reason.alias("reason"))
    rows = parsed.where(F.col("reason").isNull()).select(
        r["signature"].alias("signature"), r["slot"].alias("slot"), r["fee"].alias("fee"), r["status"].alias("status"),
        r["programIds"].alias("program_ids"), "ts")
    return rows, parsed.where(F.col("reason").isNotNull()).select(F.col("value").alias("line"), "reason")


def to_tx_jsonl(tx: DataFrame) -> DataFrame:
    """The inverse projection (for writing a log in the sample record shape)."""
    return tx.select("signature", "slot", "fee", "status", F.col("program_ids").alias("programIds"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"))


def ingest_headers(headers: DataFrame, ingest_ts: str) -> DataFrame:
    """Landed block headers -> slots rows, finalized. A header without block time gets the ingest
    time; a header that failed to arrive (no blockhash) becomes a placeholder that is not finalized."""
    failed = F.col("blockhash").isNull()
    return headers.select("slot", F.coalesce("blockhash", F.lit(UNKNOWN_BLOCKHASH)).alias("blockhash"),
                          F.when(failed, F.greatest(F.col("slot") - 1, F.lit(0))).otherwise(F.col("parent_slot")).alias("parent_slot"),
                          (~failed).alias("finalized"), F.coalesce("ts", F.lit(ingest_ts).cast("timestamp_ntz")).alias("timestamp"))


def slot_range(spark: SparkSession, low, high, step: int = 65_536) -> DataFrame:
    """Slots low..high (columns, such as scalar subqueries), generated stretch by stretch over tasks."""
    starts = spark.range(1).select(F.explode(F.sequence(F.floor(low / step).cast("long"), F.floor(high / step).cast("long"))).alias("part"))
    slots = starts.repartition("part").select(F.explode(F.sequence(F.col("part") * step, F.col("part") * step + step - 1)).alias("slot"))
    return slots.where((F.col("slot") >= low) & (F.col("slot") <= high))


def ingest_recent_slots(spark: SparkSession, headers: DataFrame, tip, count, ingest_ts: str,
                        finalized_depth: int = 32) -> DataFrame:
    """Slots tip, tip-1, ..., tip-count+1 (floored at 0, distinct); a missing header becomes a
    placeholder row (unknown blockhash, parent = slot-1 floored at 0, not finalized, ingest time).

    ``tip`` and ``count`` are numbers or columns (a scalar subquery).
    """
    tip = tip if isinstance(tip, Column) else F.lit(tip)
    ids = slot_range(spark, F.greatest(tip - count + 1, F.lit(0)), tip)
    h = headers.select("slot", "blockhash", "parent_slot", F.col("ts").alias("_hts"))
    d = ids.join(h, "slot", "left")
    found = F.col("blockhash").isNotNull()
    return d.select(
        "slot",
        F.coalesce("blockhash", F.lit(UNKNOWN_BLOCKHASH)).alias("blockhash"),
        F.when(found, F.col("parent_slot")).otherwise(F.greatest(F.col("slot") - 1, F.lit(0))).alias("parent_slot"),
        (found & (F.col("slot") <= tip - F.lit(finalized_depth))).alias("finalized"),
        F.coalesce("_hts", F.lit(ingest_ts).cast("timestamp_ntz")).alias("timestamp"))


def ingest_leaders(schedule: DataFrame) -> DataFrame:
    """(start_slot, leaders array) -> one (slot, leader) row per position."""
    return schedule.select(F.col("start_slot"), F.posexplode("leaders").alias("pos", "leader_pubkey")) \
        .select((F.col("start_slot") + F.col("pos")).alias("slot"), "leader_pubkey")


def normalise_transactions(raw: DataFrame, ingest_ts: str) -> DataFrame:
    """status = success iff metadata is present without error; fee default 0;
    block time -> timestamp, falling back to the ingest time (a column, so reruns agree).

    A binary ``signature``, as nodes send it, becomes its base-58 text (F12)."""
    meta = F.col("meta")
    binary = isinstance(raw.schema["signature"].dataType, T.BinaryType)
    return raw.select(
        base58_encode("signature").alias("signature") if binary else F.col("signature"), "slot",
        F.coalesce(meta["fee"], F.lit(0).cast("long")).alias("fee"),
        F.when(meta.isNotNull() & meta["err"].isNull(), "success").otherwise("failed").alias("status"),
        "program_ids", "block_time",
        F.coalesce(ntz_from_micros(F.col("block_time") * 1000000),
                   F.lit(ingest_ts).cast("timestamp_ntz")).alias("ts"))


def flow_blocks(docs: DataFrame, col: str = "doc") -> DataFrame:
    """Latest-block documents -> (height, id, timestamp); rows without them are skipped."""
    r = F.from_json(F.col(col), FLOW_BLOCK_DOC)["result"]
    return (docs.select(r["height"].alias("height"), r["id"].alias("id"), r["timestamp"].alias("timestamp"))
            .where(F.col("height").isNotNull() & F.col("id").isNotNull() & F.col("timestamp").isNotNull()))


def flow_events(events: DataFrame, event_type: str | None = None, col: str = "event_type") -> DataFrame:
    """Events of one type (all when None)."""
    return events if event_type is None else events.where(F.col(col) == F.lit(event_type))
