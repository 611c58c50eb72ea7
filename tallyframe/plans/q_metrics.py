"""Registered queries: metrics and the archive job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.expr import cid_of
from tallyframe.operators import archive, maintenance, metrics
from tallyframe.plans.registry import ARCHIVE_DAYS, ARCHIVE_NOW, ASOF, REJECT_BYTES, SEEN_BEFORE, oracle_text, query
from tallyframe.session import scratch_path


def r6(c):
    return F.round(F.col(c), 6).alias(c)


@query("table_stats", oracle_text("""
SELECT 'slots' AS table_name, count(*) AS n_rows FROM v_slots
UNION ALL SELECT 'transactions', count(*) FROM v_transactions
UNION ALL SELECT 'slot_leaders', count(*) FROM v_slot_leaders"""))
def table_stats(v, spark, sf):
    """A1."""
    return metrics.table_stats({"slots": v.slots, "transactions": v.transactions, "slot_leaders": v.slot_leaders})


@query("hit_ratio", oracle_text("""
SELECT round(coalesce(avg(CAST(hit AS INTEGER)), 0), 6) AS hit_ratio,
       round(coalesce(avg(CAST(hit AS INTEGER)), 0) * 100.0, 6) AS hit_percent FROM v_access_log"""))
def hit_ratio(v, spark, sf):
    """A2."""
    return metrics.hit_ratio(v.access_log).select(r6("hit_ratio"), r6("hit_percent"))


@query("request_metrics", oracle_text("""
SELECT kind, count(*) AS total_requests, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
       round(avg(response_us), 6) AS mean_response_us FROM v_access_log GROUP BY kind"""))
def request_metrics(v, spark, sf):
    """A3."""
    return metrics.request_metrics(v.access_log).select("kind", "total_requests", "hits", "misses",
                                                         r6("mean_response_us"))


@query("latency_summary", oracle_text("""
SELECT kind, round(avg(response_us), 6) AS mean_us, min(response_us) AS min_us, max(response_us) AS max_us,
       round(quantile_cont(response_us, 0.5), 6) AS p50_us, round(quantile_cont(response_us, 0.95), 6) AS p95_us,
       round(quantile_cont(response_us, 0.99), 6) AS p99_us
FROM v_access_log GROUP BY kind"""))
def latency_summary(v, spark, sf):
    """A4/A5: exact percentiles per request kind."""
    d = metrics.latency_summary(v.access_log)
    return d.select("kind", r6("mean_us"), "min_us", "max_us", r6("p50_us"), r6("p95_us"), r6("p99_us"))


THROUGHPUT_SQL = """
SELECT kind, n, first_ts, last_ts, round(elapsed_s, 6) AS elapsed_s,
       round(CASE WHEN elapsed_s > 0 THEN n / elapsed_s ELSE 0.0 END, 6) AS per_second FROM (
  SELECT kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
         CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_s
  FROM v_access_log GROUP BY kind)"""


@query("throughput", oracle_text(THROUGHPUT_SQL))
def throughput(v, spark, sf):
    """Requests per second per kind over the observed span."""
    d = metrics.throughput(v.access_log, by=["kind"])
    return d.select("kind", "n", "first_ts", "last_ts", r6("elapsed_s"), r6("per_second"))


@query("batch_rate", oracle_text("""
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end,
       count(*) AS n, round(count(*) / 3600.0, 6) AS per_second
FROM v_transactions GROUP BY 1, 2"""))
def batch_rate(v, spark, sf):
    """Transactions per hourly batch and rate."""
    d = metrics.batch_rate(v.transactions)
    return d.select("window_start", "window_end", "n", r6("per_second"))


@query("throughput_tier", oracle_text(f"""
SELECT t.kind, t.per_second, CASE WHEN t.per_second >= 1000 THEN 'excellent' WHEN t.per_second >= 500 THEN 'good'
                                  ELSE 'needs_work' END AS tier,
       t.per_second > 1000 AS rate_goal_met, m.mean_us < 1000 AS latency_goal_met
FROM ({THROUGHPUT_SQL}) t JOIN (SELECT kind, avg(response_us) AS mean_us FROM v_access_log GROUP BY kind) m
  ON m.kind = t.kind"""))
def throughput_tier(v, spark, sf):
    """Tiers and goals over the per-kind throughput and mean latency."""
    d = metrics.throughput(v.access_log, by=["kind"]).select("kind", r6("per_second"))
    lat = metrics.request_metrics(v.access_log).select("kind", F.col("mean_response_us").alias("_mean"))
    return metrics.throughput_tier(d.join(lat, "kind"), mean_us="_mean").drop("_mean")


@query("footprint", oracle_text("""
SELECT kind, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS total_bytes,
       round(CASE WHEN count(*) > 0 THEN sum(bytes) / count(*) ELSE 0.0 END, 6) AS bytes_per_entry,
       CAST(floor(sum(bytes) / 1000000) AS BIGINT) AS total_mb
FROM v_access_log GROUP BY ROLLUP (kind)"""))
def footprint(v, spark, sf):
    """A10: bytes per entry per kind plus the total row."""
    d = metrics.footprint(v.access_log)
    return d.select("kind", "entries", "total_bytes", r6("bytes_per_entry"), "total_mb")


@query("latency_of_means", oracle_text("""
SELECT round(CASE WHEN coalesce(sum(m), 0) > 0 THEN sum(m) / count(*) ELSE 0.0 END, 6) AS mean_of_means_us
FROM (SELECT kind, avg(response_us) AS m FROM v_access_log GROUP BY kind)"""))
def latency_of_means(v, spark, sf):
    """A11."""
    return metrics.latency_of_means(v.access_log).select(r6("mean_of_means_us"))


@query("block_rollup", oracle_text("""
SELECT s.slot, coalesce(a.tx_count, 0) AS tx_count, coalesce(a.total_fees, 0) AS total_fees,
       round(a.total_volume, 6) AS total_volume, coalesce(a.vote_count, 0) AS vote_count,
       round(CAST(epoch_us(c.ts) - epoch_us(s.ts) AS DOUBLE) / 1e6, 6) AS confirmation_delay_s,
       round(CAST(epoch_us(f.ts) - epoch_us(s.ts) AS DOUBLE) / 1e6, 6) AS finalization_delay_s
FROM v_slots s
LEFT JOIN (SELECT slot, count(*) AS tx_count, CAST(sum(fee) AS BIGINT) AS total_fees, sum(amount) AS total_volume,
                  count(*) FILTER (WHERE program_id = 'prog0') AS vote_count
           FROM v_transactions GROUP BY slot) a ON a.slot = s.slot
LEFT JOIN v_slots c ON c.slot = s.slot + 2
LEFT JOIN v_slots f ON f.slot = s.slot + 32"""))
def block_rollup(v, spark, sf):
    """Per-block totals and the delays until confirmed (2 slots later) and finalized (32 later)."""
    tx = v.transactions.withColumn("is_vote", F.col("program_id") == "prog0")
    d = metrics.block_rollup(tx, v.slots)
    return d.select("slot", "tx_count", "total_fees", r6("total_volume"), "vote_count",
                    r6("confirmation_delay_s"), r6("finalization_delay_s"))


@query("export_prometheus", oracle_text("""
SELECT 'tally_requests_total{kind="' || kind || '"} ' || printf('%.6f', CAST(count(*) AS DOUBLE)) AS line
FROM v_access_log GROUP BY kind
UNION ALL
SELECT 'tally_response_us_mean{kind="' || kind || '"} ' || printf('%.6f', avg(response_us)) FROM v_access_log GROUP BY kind"""))
def export_prometheus(v, spark, sf):
    """K7: exposition lines of the per-kind request metrics."""
    m = metrics.request_metrics(v.access_log)
    return maintenance.prometheus_lines(m, "tally_requests_total", "total_requests", ["kind"]).unionByName(
        maintenance.prometheus_lines(m, "tally_response_us_mean", "mean_response_us", ["kind"]))


@query("export_text", oracle_text("""
SELECT 'tally_requests_total{kind="' || kind || '"} ' || printf('%.6f', CAST(count(*) AS DOUBLE)) AS line
FROM v_access_log GROUP BY kind"""))
def export_text(v, spark, sf):
    """K7: exposition lines written as a text file and read back."""
    lines = maintenance.prometheus_lines(metrics.request_metrics(v.access_log), "tally_requests_total", "total_requests", ["kind"])
    return spark.read.text(maintenance.write_table(lines, scratch_path(spark, "metrics-text"), fmt="text")).withColumnRenamed("value", "line")


@query("export_csv", oracle_text("""
SELECT kind, count(*) AS total_requests, count(*) FILTER (WHERE hit) AS hits FROM v_access_log GROUP BY kind"""))
def export_csv(v, spark, sf):
    """K7: the per-kind request metrics written as CSV and read back."""
    rows = metrics.request_metrics(v.access_log).select("kind", "total_requests", "hits")
    return spark.read.schema(rows.schema).csv(maintenance.write_table(rows, scratch_path(spark, "metrics-csv"), fmt="csv"))


# -- archive ---------------------------------------------------------------

def archive_parts(v):
    return archive.archive(v.archive)


MANIFEST_COLS = ["cid", "name", "original_size", "mime_type", "uploaded_at", "pinned", "encrypted", "checksum"]


@query("archive_manifest", oracle_text("SELECT * FROM manifest", "manifest"))
def archive_manifest(v, spark, sf):
    """C4: content-addressed manifest of the accepted payloads."""
    return archive_parts(v)[0].select(*MANIFEST_COLS)


@query("archive_rejects", oracle_text(f"""
SELECT doc_id, name, CAST(strlen(payload) AS BIGINT) AS size_bytes, 'too_large' AS reject_reason
FROM v_archive WHERE strlen(payload) > {REJECT_BYTES}"""))
def archive_rejects(v, spark, sf):
    """Payloads above a size limit, here one that some of them exceed."""
    return archive.split_by_size(v.archive, max_bytes=REJECT_BYTES)[1].select("doc_id", "name", F.octet_length("payload").cast("long").alias("size_bytes"),
                                      "reject_reason")


@query("archive_stats", oracle_text("""
SELECT count(*) AS files, CAST(coalesce(sum(original_size), 0) AS BIGINT) AS total_bytes,
       count(*) FILTER (WHERE pinned) AS pinned_files, count(*) FILTER (WHERE encrypted) AS encrypted_files,
       (SELECT count(*) FROM v_archive WHERE strlen(payload) > 104857600) AS rejected,
       round(count(*) / (count(*) + (SELECT count(*) FROM v_archive WHERE strlen(payload) > 104857600)), 6)
         AS success_rate
FROM manifest""", "manifest"))
def archive_stats(v, spark, sf):
    """Manifest statistics and upload success rate."""
    man, rej = archive_parts(v)
    return archive.archive_stats(man, rej).select("files", "total_bytes", "pinned_files", "encrypted_files",
                                                  "rejected", r6("success_rate"))


@query("archive_lookup", oracle_text("""
SELECT * FROM manifest WHERE cid IN (SELECT cid FROM cids c JOIN documents d ON d.doc_id = c.doc_id
                                     WHERE d.lang = 'de')""", "manifest"))
def archive_lookup(v, spark, sf):
    """Manifest entries for the content ids of the German documents."""
    sums = v.t.documents.where(F.col("lang") == "de").select(F.sha2("text", 256).alias("checksum")).distinct()
    req = sums.select(cid_of("checksum").alias("cid"))
    return archive.lookup_cids(archive_parts(v)[0], req).select(*MANIFEST_COLS)


@query("archive_cleanup", oracle_text(f"""
SELECT cid, name, uploaded_at, pinned FROM manifest
WHERE NOT (uploaded_at < {ARCHIVE_NOW - ARCHIVE_DAYS * 86400} AND NOT pinned)""", "manifest"))
def archive_cleanup(v, spark, sf):
    """Entries kept by a 10-day retention at a fixed 'now' (pinned entries always kept)."""
    kept, _ = archive.cleanup(archive_parts(v)[0], ARCHIVE_NOW, ARCHIVE_DAYS)
    return kept.select("cid", "name", "uploaded_at", "pinned")


REMOVED_SQL = f"FROM manifest WHERE uploaded_at < {ARCHIVE_NOW - ARCHIVE_DAYS * 86400} AND NOT pinned"


@query("archive_removed", oracle_text(f"SELECT cid, name, uploaded_at, pinned {REMOVED_SQL}", "manifest"))
def archive_removed(v, spark, sf):
    """The entries that the retention removes."""
    return archive.cleanup(archive_parts(v)[0], ARCHIVE_NOW, ARCHIVE_DAYS)[1].select("cid", "name", "uploaded_at", "pinned")


@query("archive_removed_count", oracle_text(f"SELECT count(*) AS removed, CAST(coalesce(sum(original_size), 0) AS BIGINT) AS freed_bytes {REMOVED_SQL}", "manifest"))
def archive_removed_count(v, spark, sf):
    """How many entries the retention removes, and their bytes."""
    removed = archive.cleanup(archive_parts(v)[0], ARCHIVE_NOW, ARCHIVE_DAYS)[1]
    return removed.agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("original_size"), F.lit(0)).cast("long").alias("freed_bytes"))


@query("archive_store", oracle_text("SELECT checksum, original_size, true AS intact FROM manifest", "manifest"))
def archive_store(v, spark, sf):
    """Payloads stored as gzip JSON lines, read back and held against their checksum."""
    path = archive.store_payloads(archive.split_by_size(v.archive)[0], scratch_path(spark, "payloads"))
    back = spark.read.schema("checksum string, payload string").json(path)
    return back.select("checksum", F.octet_length("payload").cast("long").alias("original_size"), (F.sha2("payload", 256) == F.col("checksum")).alias("intact"))


@query("archive_envelope_json", oracle_text("""
SELECT signature, 'transaction' AS data_type, slot, fee, status FROM v_transactions"""))
def archive_envelope_json(v, spark, sf):
    """A JSON object as the envelope's data, read back typed."""
    tx = v.transactions.select("signature", "slot", F.floor(F.col("fee")).alias("fee"), F.struct("signature", "slot", "fee", "status").alias("record"))
    opened = archive.open_envelope(archive.envelope(tx, "transaction", "slot", "fee", "record"), data="struct<signature:string,slot:long,fee:long,status:string>")
    return opened.select("opened.data.signature", F.col("opened.data_type").alias("data_type"), "opened.data.slot", "opened.data.fee", "opened.data.status")


@query("archive_verify", oracle_text("""
SELECT m.cid, m.name, s.cid IS NOT NULL AS restored,
       coalesce(s.h = m.checksum AND CAST(strlen(s.payload) AS BIGINT) = m.original_size, false) AS verified
FROM manifest m LEFT JOIN (SELECT DISTINCT ON (cid) cid, h, payload FROM cids) s ON s.cid = m.cid""", "manifest"))
def archive_verify(v, spark, sf):
    """Every manifest entry restored from the stored payloads and checked."""
    return archive.verify(archive_parts(v)[0], v.archive)


@query("archive_envelope", oracle_text("""
SELECT doc_id, 'document' AS data_type, true AS roundtrip_ok FROM v_archive"""))
def archive_envelope(v, spark, sf):
    """Each payload wrapped in a typed JSON envelope and read back."""
    env = archive.envelope(v.archive, "document", "doc_id", "uploaded_at", "payload", {"name": "name"})
    opened = archive.open_envelope(env)
    ok = (F.col("opened.data") == F.col("payload")) & (F.col("opened.slot") == F.col("doc_id")) \
        & (F.col("opened.metadata")["name"] == F.col("name"))
    return opened.select("doc_id", F.col("opened.data_type").alias("data_type"), ok.alias("roundtrip_ok"))


@query("latency_summary_approx", oracle_text("""
SELECT kind, round(avg(response_us), 6) AS mean_us, min(response_us) AS min_us, max(response_us) AS max_us,
       true AS p50_close, true AS p95_close, true AS p99_close FROM v_access_log GROUP BY kind"""))
def latency_summary_approx(v, spark, sf):
    """A5 as a bounded sketch per kind; each percentile's rank is checked against the exact counts of the values."""
    accuracy, asked = 10000, (0.5, 0.95, 0.99)
    sketch = metrics.latency_summary_approx(v.access_log, accuracy=accuracy)
    counts = metrics.value_counts(v.access_log, ["kind"], "response_us")
    got = F.col("p50_p95_p99_us")
    ranks = counts.join(sketch, "kind").groupBy("kind", "mean_us", "min_us", "max_us").agg(
        F.max("upto").alias("n"), *(F.coalesce(F.max(F.when(F.col("response_us") <= got[i], F.col("upto"))), F.lit(0)).alias(f"to_{i}") for i in range(3)),
        *(F.coalesce(F.max(F.when(F.col("response_us") < got[i], F.col("upto"))), F.lit(0)).alias(f"before_{i}") for i in range(3)))

    def close(i, p):
        slack = F.col("n") / F.lit(accuracy) + 1
        return ((F.col(f"to_{i}") >= F.col("n") * p - slack) & (F.col(f"before_{i}") <= F.col("n") * p + slack)).alias(f"p{int(100 * p)}_close")

    return ranks.select("kind", r6("mean_us"), "min_us", "max_us", *(close(i, p) for i, p in enumerate(asked)))


@query("latency_rollup", oracle_text(f"""
SELECT kind, n, mean_us, min_us, max_us, p50_us, p95_us, p99_us FROM (
  SELECT kind, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(total) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS mean_us, min(least) AS min_us, max(most) AS max_us,
         min(CASE WHEN upto >= ceil(alln * CAST(0.5 AS DOUBLE)) THEN middle END) AS p50_us,
         min(CASE WHEN upto >= ceil(alln * CAST(0.95 AS DOUBLE)) THEN middle END) AS p95_us,
         min(CASE WHEN upto >= ceil(alln * CAST(0.99 AS DOUBLE)) THEN middle END) AS p99_us
  FROM (SELECT *, greatest(least, least(most, low + (((CAST(1 AS BIGINT) << shift) - 1) >> 1))) AS middle,
               sum(n) OVER (PARTITION BY kind ORDER BY low) AS upto, sum(n) OVER (PARTITION BY kind) AS alln
        FROM (SELECT kind, (response_us >> shift) << shift AS low, shift, count(*) AS n, sum(response_us) AS total,
                     min(response_us) AS least, max(response_us) AS most
              FROM (SELECT *, CAST(greatest(length(bin(response_us)) - 8, 0) AS BIGINT) AS shift FROM v_access_log
                    WHERE ts >= TIMESTAMP '{SEEN_BEFORE}' AND ts < TIMESTAMP '{ASOF}')
              GROUP BY ALL))
  GROUP BY kind)"""))
def latency_rollup(v, spark, sf):
    """A5 from stored hourly histograms: percentiles of a range of hours, the log itself is not read again."""
    path = scratch_path(spark, "latency-hours")
    hours = metrics.latency_histogram(v.access_log)
    hours.write.mode("error").parquet(path)
    stored = spark.read.schema(hours.schema).parquet(path)
    span = stored.where((F.col("hour") >= F.lit(SEEN_BEFORE).cast("timestamp_ntz")) & (F.col("hour") < F.lit(ASOF).cast("timestamp_ntz")))
    return metrics.histogram_percentiles(span).withColumn("mean_us", r6("mean_us"))
