"""Aggregations: counts, hit ratio, latency, throughput, rates, footprint.

All are hash aggregates with map-side partial aggregation; a hot group key
(a request kind with a third of the rows) is combined per task before the
shuffle. Exact percentiles are minima over running counts of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expr import unix_micros_ntz
from tallyframe.operators.sequence import with_running_total


def table_stats(named: dict[str, DataFrame]) -> DataFrame:
    """A1: one (table, n_rows) row per relation."""
    out = None
    for name, df in named.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def hit_ratio(log: DataFrame, by: Sequence[str] = (), hit: str = "hit") -> DataFrame:
    """A2: hits / (hits + misses), 0 when empty; also as percent."""
    g = log.groupBy(*by) if by else log.groupBy()
    return g.agg(F.coalesce(F.avg(F.col(hit).cast("int")), F.lit(0.0)).alias("hit_ratio")) \
        .withColumn("hit_percent", F.col("hit_ratio") * 100.0)


def request_metrics(log: DataFrame, by: Sequence[str] = ("kind",), hit: str = "hit",
                    value: str = "response_us") -> DataFrame:
    """A3: totals, hits, misses, mean response."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col(hit)).alias("hits"),
        F.count_if(~F.col(hit)).alias("misses"),
        F.avg(value).alias("mean_response_us"))


def value_counts(log: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value) and, along the values of a group, the rows up to and including it (``upto``).

    Counting is map-side and the running total is chunked (``sequence``), so no task holds a group's values."""
    counts = log.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return with_running_total(counts, by, [value], "n", out="upto")


def latency_summary(log: DataFrame, by: Sequence[str] = ("kind",), value: str = "response_us",
                    percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """A4/A5: mean, min, max and exact percentiles (interpolated between neighbours) per group.

    The value at place i (from 0) is the smallest one with more than i rows up to it: a minimum, which
    combines map-side like the other aggregates here."""
    counts = value_counts(log, by, value)
    v, total = F.col(value), F.col("_total")
    whole = counts.groupBy(*by).agg(F.sum("n").alias("_total")).withColumnsRenamed({c: f"_w_{c}" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    d = counts.join(whole, cond).drop(*(f"_w_{c}" for c in by))
    places = {f"p{int(round(100 * p))}_us": (total - 1) * F.lit(float(p)) for p in percentiles}
    at = [F.min(F.when(F.col("upto") > f(place), v)).alias(f"_{side}_{name}") for name, place in places.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    out = d.groupBy(*by).agg((F.sum(v * F.col("n")) / F.sum("n")).alias("mean_us"), F.min(v).alias("min_us"), F.max(v).alias("max_us"), F.max("_total").alias("_total"), *at)

    def between(name, place):
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return out.select(*by, "mean_us", "min_us", "max_us", *(between(n, p) for n, p in places.items()))


def latency_summary_approx(log: DataFrame, by: Sequence[str] = ("kind",), value: str = "response_us",
                           accuracy: int = 10000) -> DataFrame:
    """A5 at scale: bounded-memory percentile sketch, combined map-side."""
    v = F.col(value)
    return log.groupBy(*by).agg(
        F.avg(v).alias("mean_us"), F.min(v).alias("min_us"), F.max(v).alias("max_us"),
        F.percentile_approx(v, [0.5, 0.95, 0.99], accuracy).alias("p50_p95_p99_us"))


def throughput(log: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows per second between the first and last timestamp; 0 when the span is 0."""
    g = log.groupBy(*by) if by else log.groupBy()
    d = g.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    secs = (unix_micros_ntz("last_ts") - unix_micros_ntz("first_ts")).cast("double") / 1e6
    return d.withColumn("elapsed_s", secs) \
        .withColumn("per_second", F.when(F.col("elapsed_s") > 0, F.col("n") / F.col("elapsed_s"))
                    .otherwise(F.lit(0.0)))


def batch_rate(log: DataFrame, width: str = "1 hour", width_s: float = 3600.0, ts: str = "ts",
               by: Sequence[str] = ()) -> DataFrame:
    """Rows per tumbling window and rate per second."""
    return (log.groupBy(F.window(ts, width).alias("w"), *by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n",
                    (F.col("n") / F.lit(width_s)).alias("per_second")))


def throughput_tier(df: DataFrame, rate: str = "per_second", mean_us: str | None = None) -> DataFrame:
    """>= 1000 excellent, >= 500 good, else needs work; goals: rate > 1000/s and,
    when a mean latency column is given, mean < 1 ms."""
    r = F.col(rate)
    out = df.withColumn("tier", F.when(r >= 1000, "excellent").when(r >= 500, "good").otherwise("needs_work")) \
        .withColumn("rate_goal_met", r > 1000)
    if mean_us is not None:
        out = out.withColumn("latency_goal_met", F.col(mean_us) < 1000)
    return out


def footprint(df: DataFrame, by: str = "kind", size: str = "bytes") -> DataFrame:
    """A10: entries, bytes, bytes per entry (0 when empty) and whole MB by integer
    division, per group plus a total row (group null) via rollup."""
    return (df.rollup(by).agg(F.count(F.lit(1)).alias("entries"), F.sum(size).cast("long").alias("total_bytes"))
            .withColumn("bytes_per_entry", F.when(F.col("entries") > 0, F.col("total_bytes") / F.col("entries"))
                        .otherwise(F.lit(0.0)))
            .withColumn("total_mb", F.floor(F.col("total_bytes") / 1000000).cast("long")))


def latency_of_means(log: DataFrame, by: str = "kind", value: str = "response_us") -> DataFrame:
    """Mean of the per-group means; 0 if they sum to 0 or there are none."""
    means = log.groupBy(by).agg(F.avg(value).alias("m"))
    return means.agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("k")).select(
        F.when(F.coalesce(F.col("s"), F.lit(0.0)) > 0, F.col("s") / F.col("k")).otherwise(F.lit(0.0))
        .alias("mean_of_means_us"))


def block_rollup(tx: DataFrame, slots: DataFrame, confirmed_depth: int = 2, finalized_depth: int = 32,
                 vote: str = "is_vote") -> DataFrame:
    """Per block: transactions, fees, volume, votes, and the delays until the
    block became confirmed / finalized (time of the block ``depth`` slots later).

    Every block tells its time to itself and to the blocks that it confirms and finalizes, and one
    aggregate by slot gathers times and transactions: no self-joins."""
    none = {"ts": F.lit(None).cast("timestamp_ntz"), "n": F.lit(0).cast("long"), "fee": F.lit(None).cast("long"), "amount": F.lit(None).cast("double"), "vote": F.lit(0), "role": F.lit("tx")}
    depths = F.array(*(F.struct(F.lit(d).cast("long").alias("depth"), F.lit(r).alias("role")) for d, r in ((0, "own"), (confirmed_depth, "confirmed"), (finalized_depth, "finalized"))))
    times = slots.select("slot", "ts", F.inline(depths)).select((F.col("slot") - F.col("depth")).alias("slot"), *(F.col(c) if c in ("ts", "role") else none[c].alias(c) for c in none))
    facts = tx.select("slot", *({"n": F.lit(1).cast("long"), "fee": F.col("fee").cast("long"), "amount": F.col("amount").cast("double"), "vote": F.col(vote).cast("int")}.get(c, none[c]).alias(c) for c in none))
    at = {r: F.max(F.when(F.col("role") == r, F.col("ts"))) for r in ("own", "confirmed", "finalized")}
    d = times.unionByName(facts).groupBy("slot").agg(
        F.sum("n").alias("tx_count"), F.coalesce(F.sum("fee"), F.lit(0)).cast("long").alias("total_fees"), F.sum("amount").alias("total_volume"),
        F.coalesce(F.sum("vote"), F.lit(0)).cast("long").alias("vote_count"), F.count_if(F.col("role") == "own").alias("_own"), *(c.alias(f"_{r}_ts") for r, c in at.items()))

    def delay(role, name):
        return ((unix_micros_ntz(f"_{role}_ts") - unix_micros_ntz("_own_ts")).cast("double") / 1e6).alias(name)

    return d.where(F.col("_own") > 0).select("slot", "tx_count", "total_fees", "total_volume", "vote_count",
                                              delay("confirmed", "confirmation_delay_s"), delay("finalized", "finalization_delay_s"))


HISTOGRAM_BITS = 8  # leading bits of a value that its bucket keeps: a bucket's middle is within 1/256 of its values


def latency_histogram(log: DataFrame, by: Sequence[str] = ("kind",), value: str = "response_us", ts: str = "ts") -> DataFrame:
    """A5, to be stored: per group and ``hour``, buckets of integer values that share their leading bits.

    One row a bucket: ``low``, ``shift`` (it holds low to low + 2**shift - 1), ``n``, ``total``, ``least``, ``most``. A group has
    at most 2 x 7,424 buckets whatever its rows, and rows of different hours, batches or tables merge by adding.
    Null values count nowhere; values below zero have buckets of the same widths.
    """
    v = F.col(value).cast("long")
    size = F.when(v < 0, -(v + 1)).otherwise(v)
    shift = F.when(size >= 1 << HISTOGRAM_BITS, F.length(F.bin(size)) - HISTOGRAM_BITS).otherwise(0)
    rows = log.where(v.isNotNull()).select(*by, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"), v.alias("_v"), shift.alias("shift"))
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("_v"), F.col("shift")), F.col("shift"))
    return rows.groupBy(*by, "hour", low.alias("low"), "shift").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_v").cast("decimal(20,0)")).alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merge_histograms(parts: Sequence[DataFrame]) -> DataFrame:
    """Stored histograms of the same groups as one; equal buckets are added."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    keys = [c for c in out.columns if c not in ("n", "total", "least", "most")]
    return out.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(30,0)").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def histogram_percentiles(stored: DataFrame, by: Sequence[str] = ("kind",), asked: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, least, most and percentiles per group over all the hours that ``stored`` holds.

    A percentile is that of the nearest rank (the ceil(p x n)-th value), as the middle of its bucket: the rank is
    exact, the value within 1/256. The window runs over a group's buckets, not its rows, and these are bounded.
    """
    group = [F.col(c) for c in by]
    buckets = stored.groupBy(*by, "low", "shift").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    so_far = Window.partitionBy(*group).orderBy("low", "shift").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*group)
    buckets = buckets.select("*", F.sum("n").over(so_far).alias("_upto"), F.sum("n").over(all_of).alias("_all"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift"))
    middle = F.greatest("least", F.least("most", F.col("low") + F.call_function("shiftright", width - 1, F.lit(1))))
    return buckets.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("total").cast("double") / F.sum("n")).alias("mean_us"), F.min("least").alias("min_us"), F.max("most").alias("max_us"),
        *(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(p)), middle)).alias(f"p{round(100 * p)}_us") for p in asked))
