"""Content-addressed archive: envelope, size limit, manifest, lookup, retention, verify.

The content id and checksum are Catalyst expressions (sha2 + base32 digits),
so the manifest is one projection plus an upsert on cid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expr import cid_of
from tallyframe.operators.maintenance import write_table

MAX_BYTES = 100 * 1024 * 1024  # fixed value: 100 MiB upload limit


def envelope(df: DataFrame, data_type: str, slot: str, ts_seconds: str, data: str,
             metadata: dict[str, str] | None = None) -> DataFrame:
    """Typed envelope serialised to JSON bytes; ``data`` may be any column, a struct becomes a JSON object."""
    meta = F.create_map(*[x for k, c in (metadata or {}).items() for x in (F.lit(k), F.col(c).cast("string"))]) \
        if metadata else F.create_map().cast("map<string,string>")
    env = F.struct(F.lit(data_type).alias("data_type"), F.col(slot).cast("long").alias("slot"),
                   F.col(ts_seconds).cast("long").alias("timestamp"), F.col(data).alias("data"),
                   meta.alias("metadata"))
    return df.withColumn("envelope", F.to_json(env).cast("binary"))


def open_envelope(df: DataFrame, col: str = "envelope", data: str = "string") -> DataFrame:
    """JSON bytes back to the typed envelope, its data of the given type."""
    schema = f"data_type string, slot long, timestamp long, data {data}, metadata map<string,string>"
    return df.withColumn("opened", F.from_json(F.col(col).cast("string"), schema))


def split_by_size(df: DataFrame, payload: str = "payload", max_bytes: int = MAX_BYTES):
    """(accepted, rejected) by payload byte length."""
    n = F.octet_length(F.col(payload))
    return df.where(n <= max_bytes), df.where(n > max_bytes).withColumn("reject_reason", F.lit("too_large"))


def manifest(df: DataFrame, payload: str = "payload", name: str = "name", mime: str = "text/plain",
             uploaded_at: str = "uploaded_at", pinned: str = "pinned") -> DataFrame:
    """C4: one manifest row per distinct content; same content -> same cid -> the latest
    upload's metadata wins. The hash is over the uncompressed payload; it is taken once per row, and
    the cid follows from it once per content."""
    rows = df.select(F.sha2(F.col(payload), 256).alias("checksum"), F.col(name).alias("name"),
                     F.octet_length(F.col(payload)).cast("long").alias("original_size"),
                     F.lit(mime).alias("mime_type"), F.col(uploaded_at).cast("long").alias("uploaded_at"),
                     F.col(pinned).alias("pinned"), F.lit(False).alias("encrypted"))
    # Upload order: uploaded_at, then name for ties; the last upload's metadata wins.
    rest = [c for c in rows.columns if c != "checksum"]
    last = rows.groupBy("checksum").agg(F.max_by(F.struct(*rest), F.struct("uploaded_at", "name")).alias("_r"))
    return last.select(cid_of("checksum").alias("cid"), *[F.col("_r")[c].alias(c) for c in rest], "checksum")


def store_payloads(df: DataFrame, path: str, payload: str = "payload") -> str:
    """Distinct payloads with their checksum as gzip JSON lines."""
    rows = df.select(F.sha2(F.col(payload), 256).alias("checksum"), F.col(payload).alias("payload"))
    return write_table(rows.groupBy("checksum").agg(F.first("payload").alias("payload")), path, fmt="json", compression="gzip")


def archive(df: DataFrame, max_bytes: int = MAX_BYTES, **kw):
    """(manifest of accepted payloads, rejected rows)."""
    ok, rejected = split_by_size(df, kw.get("payload", "payload"), max_bytes)
    return manifest(ok, **kw), rejected


def lookup_cids(man: DataFrame, cids: DataFrame) -> DataFrame:
    """C5."""
    return man.join(cids.select("cid"), "cid", "left_semi")


def cleanup(man: DataFrame, now_epoch: int, days: int):
    """(kept, removed): removed when uploaded before now - days and not pinned."""
    old = (F.col("uploaded_at") < F.lit(now_epoch - days * 86400)) & ~F.col("pinned")
    return man.where(~old), man.where(old)


def verify(man: DataFrame, stored: DataFrame, payload: str = "payload") -> DataFrame:
    """Restore each manifest entry from stored payloads and check the checksum and size."""
    s = (stored.groupBy(F.sha2(F.col(payload), 256).alias("_sum")).agg(F.max(F.octet_length(F.col(payload)).cast("long")).alias("_size"))
         .select(cid_of("_sum").alias("cid"), "_sum", "_size"))
    d = man.join(s, "cid", "left")
    return d.select("cid", "name", F.col("_sum").isNotNull().alias("restored"),
                    (F.coalesce(F.col("_sum") == F.col("checksum"), F.lit(False))
                     & F.coalesce(F.col("_size") == F.col("original_size"), F.lit(False))).alias("verified"))


def archive_stats(man: DataFrame, rejected: DataFrame) -> DataFrame:
    """Files, bytes, pinned and encrypted counts from the manifest, and the success rate."""
    m = man.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("original_size"), F.lit(0)).cast("long")
                .alias("total_bytes"), F.count_if("pinned").alias("pinned_files"),
                F.count_if("encrypted").alias("encrypted_files"))
    n_rejected = rejected.select(F.count(F.lit(1))).scalar()
    return m.withColumn("rejected", n_rejected).select(
        "files", "total_bytes", "pinned_files", "encrypted_files", "rejected",
        F.when(F.col("files") + F.col("rejected") > 0, F.col("files") / (F.col("files") + F.col("rejected")))
        .otherwise(F.lit(0.0)).alias("success_rate"))
