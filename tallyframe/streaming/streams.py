"""Structured Streaming forms of the keyed operators.

* R1 ``account_change_batches`` and R3 ``slot_change_batches``: ``foreachBatch`` over the batch
  operators. A micro-batch is joined to the last states of its own keys, goes through the same
  chunked window as a batch job, and its results and new last states are written under its batch id.
* R2 ``recent_signature_batches``: what is new among the last 10 signatures of an address, poll by poll;
  ``new_signature_batches``: the first sighting of a pair within a delay; ``new_signature_stream``: the same by
  ``dropDuplicates``, exact and unbounded, or within a watermark.
* R4 ``filtered_tx_stream``: stateless subscription filter.
* R5 ``fresh_state_batches``: the last state per key, for a time to live since it was written and a time to idle since it was touched.
* A7 ``batch_rate_batches``: rows per tumbling window, once the clock has passed it; ``batch_rate_stream``: the same by a watermark.

Event time stays TIMESTAMP_NTZ; only watermarked streams cast to TIMESTAMP (watermarks reject NTZ).
Everything is written under the shared folder, so a lost executor or a restarted driver resumes from
the last commit, and a retried micro-batch replaces its own folder. A job's clock is the latest event time of
the batches before. A row that is not newer than the stored state of its key, or that is older than the clock less
the job's delay, is late: it goes to the ``rejects`` output, never silently away. (The watermarked forms drop such rows.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators.changes import STATE_FIELDS, account_changes, distinct_until_changed
from tallyframe.operators.ledger import subscription_filter
from tallyframe.operators.sequence import with_previous
from tallyframe.session import scratch_path, scratch_scope

#: A stored state is written whole after this many micro-batches, so a read covers that many at most.
COMPACT_EVERY = 64


# -- running ------------------------------------------------------------------

def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1,
                max_bytes_per_trigger: str | None = None) -> DataFrame:
    """File stream source; the per-trigger bounds bound a micro-batch."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.parquet(path)


def start_stream(stream: DataFrame, sink_path: str, checkpoint: str, processing_time: str | None = None,
                 fmt: str = "parquet", output_mode: str = "append"):
    """A continuously running query polled at ``processing_time`` (e.g. '10 seconds'),
    or drained once with availableNow when None. Returns the StreamingQuery."""
    w = stream.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start(sink_path)


def start_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, processing_time: str | None = None):
    """S10 for ``foreachBatch`` sinks."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def _drained(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def idempotent_batch_writer(path: str, fmt: str = "parquet"):
    """K3: a ``foreachBatch`` function that appends each micro-batch under ``batch_id=<id>``,
    overwriting only that batch's folder, so a retried batch replaces rather than duplicates."""
    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def run_available_now(stream: DataFrame, spark: SparkSession, name: str, fmt: str = "parquet") -> DataFrame:
    """Drain everything available into an exactly-once file sink, then read the sink back."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    _drained(start_stream(stream, out, ckpt, fmt=fmt))
    return spark.read.schema(stream.schema).format(fmt).load(out)


class BatchFolders:
    """The folders of a ``foreachBatch`` job under ``path``: out, rejects and state, one subfolder per batch id."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, df: DataFrame, what: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/batch_id={batch_id}")

    def read(self, spark: SparkSession, what: str, schema: T.StructType) -> DataFrame:
        """All rows written so far; none if there was no batch yet."""
        files = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            return spark.createDataFrame([], schema)
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{self.path}/{what}")

    def state(self, spark: SparkSession, schema: T.StructType, batch_id: int) -> DataFrame:
        """State rows before ``batch_id``, with the ``batch_id`` that wrote them: the last one written whole, and those after it."""
        rows = self.read(spark, "state", schema)
        if "batch_id" not in rows.columns:
            return rows.withColumn("batch_id", F.lit(-1).cast("long"))
        whole = batch_id // COMPACT_EVERY * COMPACT_EVERY - 1
        return rows.where((F.col("batch_id") >= whole) & (F.col("batch_id") < batch_id))

    def clock(self, spark: SparkSession, batch_id: int) -> Column:
        """The latest event time of the batches before ``batch_id``; null before the first one."""
        seen = self.read(spark, "clock", CLOCK)
        return (seen.where(F.col("batch_id") < batch_id) if "batch_id" in seen.columns else seen).agg(F.max("clock")).scalar()

    def tick(self, batch: DataFrame, ts: str, batch_id: int) -> None:
        self.write(batch.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("clock")), "clock", batch_id)


def whole_state(batch_id: int) -> bool:
    """Whether a batch writes the state whole."""
    return (batch_id + 1) % COMPACT_EVERY == 0


CLOCK = T.StructType([T.StructField("clock", T.TimestampNTZType())])


def _once(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as scratch, so that its readers do not compute it again each."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _span(delay: str) -> Column:
    return F.expr(f"INTERVAL {delay}")


def _latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of highest order per key (of all rows without keys), by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.where(F.col("_r").isNotNull()).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def _stateful(folders: BatchFolders, keys: Sequence[str], order: Sequence[str], run: Callable[[DataFrame], DataFrame]):
    """A ``foreachBatch`` function: ``run`` gets the new rows after the last states of their keys (``_seed`` tells them)."""
    keys, order = list(keys), list(order)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        with scratch_scope(spark):
            batch = _once(spark, batch, "batch")
            stored = folders.state(spark, batch.schema, batch_id).drop("batch_id")
            touched = batch.select(*keys).distinct() if keys else None
            last = _once(spark, _latest(stored.join(touched, keys, "left_semi") if keys else stored, keys, order).select(*columns), "last")
            ranks = last.select(*keys, F.struct(*order).alias("_last"))
            ranked = batch.join(ranks, keys, "left") if keys else batch.withColumn("_last", ranks.select("_last").scalar())
            ranked = _once(spark, ranked.withColumn("_fresh", F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))), "ranked")
            news = ranked.where("_fresh").select(*columns)
            folders.write(ranked.where("not _fresh").select(*columns), "rejects", batch_id)
            rows = last.withColumn("_seed", F.lit(True)).unionByName(news.withColumn("_seed", F.lit(False)))
            folders.write(run(rows), "out", batch_id)
            folders.write(_latest(stored.unionByName(news) if whole_state(batch_id) else news, keys, order).select(*columns), "state", batch_id)

    return write


# -- R1: account change detection ---------------------------------------------

def account_change_batches(path: str, key: str = "account_address", order: Sequence[str] = ("slot", "ts", "id")):
    """A ``foreachBatch`` function that writes the changes of each micro-batch under ``path``.

    The changes are those the batch operator finds between an account's new states and its last stored
    one. States of an account arrive in order over micro-batches; late ones go to ``rejects``."""

    def run(rows: DataFrame) -> DataFrame:
        # only the first of an account's rows can be the stored one, and it has no predecessor here
        return account_changes(rows.drop("_seed"), key, order)

    return _stateful(BatchFolders(path), [key], order, run)


SNAPSHOT_COLS = ("id", "account_address", *STATE_FIELDS, "slot", "ts")


def run_account_changes(spark: SparkSession, snapshots: DataFrame, name: str = "account-changes") -> DataFrame:
    """R1 drained: all change rows of a stream of snapshots."""
    path, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    _drained(start_batches(snapshots.select(*SNAPSHOT_COLS), account_change_batches(path), ckpt))
    schema = account_changes(spark.createDataFrame([], snapshots.select(*SNAPSHOT_COLS).schema)).schema
    return BatchFolders(path).read(spark, "out", schema).select(*schema.names)


# -- R3: distinct-until-changed slot stream ----------------------------------

def slot_change_batches(path: str, order: Sequence[str] = ("ts", "signature"), source: Sequence[str] = ()):
    """A ``foreachBatch`` function that writes a slot only when it differs from the one before it.

    Without ``source`` the stream is one sequence, and the only thing carried over is its last row."""

    def run(rows: DataFrame) -> DataFrame:
        return distinct_until_changed(rows, "slot", order, source).where(~F.col("_seed")).drop("_seed")

    return _stateful(BatchFolders(path), source, order, run)


def run_batches(spark: SparkSession, stream: DataFrame, job: Callable[[str], Callable[[DataFrame, int], None]], name: str, processing_time: str | None = None) -> str:
    """Drain a ``foreachBatch`` job, and return the folder it wrote to; with ``processing_time`` it polls at that interval until nothing new has come."""
    path, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    query = start_batches(stream, job(path), ckpt, processing_time)
    if processing_time:
        query.processAllAvailable()
        query.stop()
    else:
        _drained(query)
    return path


def run_slot_changes(spark: SparkSession, tx: DataFrame, name: str = "slot-stream") -> DataFrame:
    """R3 drained."""
    path, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    tx = tx.select("signature", "slot", "ts")
    _drained(start_batches(tx, slot_change_batches(path), ckpt))
    return BatchFolders(path).read(spark, "out", tx.schema).select(*tx.columns)


# -- R2, R4, R5, A7 -------------------------------------------------------------

def _watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def new_signature_stream(df: DataFrame, keys: Sequence[str] = ("address", "signature"),
                         watermark: str | None = None) -> DataFrame:
    """R2: emit each (address, signature) the first time it is seen.

    Without ``watermark`` the dedup state is exact and unbounded (sharded by key);
    with it, duplicates are only suppressed within the watermark delay."""
    if watermark is None:
        return df.dropDuplicates(list(keys))
    return _watermarked(df, "ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def filtered_tx_stream(df: DataFrame, **filters) -> DataFrame:
    """The subscription filter applied to a pushed transaction stream (stateless)."""
    return subscription_filter(df, **filters)


def recent_signature_batches(path: str, address: str = "address", signature: str = "signature", order: Sequence[str] = ("ts", "signature"), keep: int = 10):
    """R2: a ``foreachBatch`` function that treats each micro-batch as a poll.

    An address's list is its ``keep`` latest signatures so far, by ``order``. What is on it now and was not on it after the
    address's last poll is new; so all of a first poll's list is, and a signature that had left the list and comes again."""
    folders = BatchFolders(path)
    columns = list(dict.fromkeys([address, signature, *order]))
    latest = Window.partitionBy(address).orderBy(*(F.desc(c) for c in order))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = _once(spark, batch.select(*columns), "poll")
            state = folders.state(spark, rows.schema, batch_id)
            # an address's list is what its last poll wrote
            polls = state.groupBy(F.col(address).alias("_a")).agg(F.max("batch_id").alias("_b"))
            lists = state.join(polls, F.col(address).eqNullSafe(F.col("_a")) & (F.col("batch_id") == F.col("_b"))).select(*columns)
            touched = rows.select(F.col(address).alias("_a")).distinct()
            before = _once(spark, lists.join(touched, F.col(address).eqNullSafe(F.col("_a")), "left_semi"), "lists")
            sightings = before.unionByName(rows).groupBy(address, signature).agg(F.max(F.struct(*order)).alias("_at"))
            sightings = sightings.select(address, signature, *(F.col("_at")[c].alias(c) for c in order if c not in (address, signature)))
            now = _once(spark, sightings.withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= keep).select(*columns), "now")
            was = before.select(F.col(address).alias("_a"), F.col(signature).alias("_s"))
            folders.write(now.join(was, F.col(address).eqNullSafe(F.col("_a")) & F.col(signature).eqNullSafe(F.col("_s")), "left_anti"), "out", batch_id)
            others = lists.join(touched, F.col(address).eqNullSafe(F.col("_a")), "left_anti")
            folders.write(now.unionByName(others) if whole_state(batch_id) else now, "state", batch_id)

    return write


def new_signature_batches(path: str, keys: Sequence[str] = ("address", "signature"), ts: str = "ts", delay: str = "1 day"):
    """R2: a ``foreachBatch`` function that writes the earliest row of each key, unless the key was seen within ``delay`` before; late rows go to ``rejects``."""
    folders, keys = BatchFolders(path), list(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = _once(spark, batch, "batch")
            clock = folders.clock(spark, batch_id)
            late = F.coalesce(F.col(ts) < clock - _span(delay), F.lit(False))
            folders.write(rows.where(late), "rejects", batch_id)
            columns = [*keys, ts]
            seen = folders.state(spark, rows.select(*columns).schema, batch_id).where(F.coalesce(F.col(ts) >= clock - _span(delay), F.lit(True))).select(*columns)
            first = rows.where(~late).groupBy(*keys).agg(F.min(ts).alias(ts))
            known = seen.select(F.struct(*keys).alias("_k")).distinct()
            news = _once(spark, first.join(known, F.struct(*keys).eqNullSafe(F.col("_k")), "left_anti").select(*columns), "news")
            folders.write(news, "out", batch_id)
            folders.write(seen.unionByName(news) if whole_state(batch_id) else news, "state", batch_id)
            folders.tick(rows, ts, batch_id)

    return write


def batch_rate_batches(path: str, width: str = "1 hour", width_s: float = 3600.0, delay: str = "1 hour", ts: str = "ts", by: Sequence[str] = ()):
    """A ``foreachBatch`` function that writes the rate of each tumbling window once the clock is ``delay`` past its end.

    Rows of windows that were written before are late and go to ``rejects``. The state is the counts of the open windows."""
    folders, by = BatchFolders(path), list(by)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = _once(spark, batch.select(*batch.columns, F.window(ts, width).alias("_w")), "batch")
            before = folders.clock(spark, batch_id)
            late = F.coalesce(F.col("_w.end") <= before - _span(delay), F.lit(False))
            folders.write(rows.where(late).drop("_w"), "rejects", batch_id)
            news = rows.where(~late).groupBy(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by).agg(F.count(F.lit(1)).alias("n"))
            state = folders.state(spark, news.schema, batch_id).where(F.col("batch_id") == batch_id - 1).select(*news.columns)
            counts = _once(spark, state.unionByName(news).groupBy("window_start", "window_end", *by).agg(F.sum("n").alias("n")), "counts")
            folders.tick(rows, ts, batch_id)
            closed = F.coalesce(F.col("window_end") <= folders.clock(spark, batch_id + 1) - _span(delay), F.lit(False))
            folders.write(counts.where(closed).select("window_start", "window_end", *by, "n", (F.col("n") / F.lit(width_s)).alias("per_second")), "out", batch_id)
            folders.write(counts.where(~closed), "state", batch_id)  # the open windows are the whole state

    return write


def fresh_state_batches(path: str, key: str, columns: Sequence[str], ttl: str, idle: str | None = None, ts: str = "ts", seq: str = "id", read: str | None = None):
    """A ``foreachBatch`` function that keeps the last state per key, with the times it was ``written`` and ``touched``.

    A state lives for ``ttl`` after it was written and, with ``idle``, until it has not been touched for that long; where the
    flag ``read`` is true a row only touches the key's state, and one that is no longer alive is not revived. ``fresh`` reads what is alive at a time.
    A key's rows are taken by (``ts``, ``seq``); rows without a key take no part. States past their ``ttl`` by the clock leave the state where it is
    written whole, so touches may come late by what is left of it."""
    folders, columns = BatchFolders(path), list(columns)
    is_read = F.coalesce(F.col(read), F.lit(False)) if read else F.lit(False)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_scope(spark):
            rows = _once(spark, batch.select(key, *columns, ts, seq, is_read.alias("_read")), "batch")
            schema = rows.select(key, *columns, F.col(ts).alias("written"), F.col(seq).alias("sequence"), F.col(ts).alias("touched")).schema
            state = _latest(folders.state(spark, schema, batch_id), [key], ["batch_id"]).select(*schema.names)
            known = state.join(rows.select(key).distinct(), key, "left_semi")
            writes = rows.where("not _read").select(key, *columns, F.col(ts).alias("written"), F.col(seq).alias("sequence"), F.col(ts).alias("touched"))
            last = _once(spark, _latest(known.unionByName(writes), [key], ["written", "sequence"]).select(*schema.names), "last")
            # touches since the last write, in order; the first gap over the idle time ends them
            touches = (last.select(key, F.col("touched").alias("_t"), F.lit(0).alias("_n")).unionByName(
                rows.join(last.select(key, "written", "touched"), key).where(F.col("_read") & (F.col(ts) >= F.col("written")) & (F.col(ts) >= F.col("touched")))
                .select(key, F.col(ts).alias("_t"), F.lit(1).alias("_n"))))
            if idle is None:
                ends = touches.groupBy(key).agg(F.max("_t").alias("_end"))
            else:
                gaps = with_previous(touches.withColumn("_s", F.monotonically_increasing_id()), [key], ["_t", "_n", "_s"], ["_t"], out="_p")
                broken = F.col("_t") > F.col("_p._t") + _span(idle)
                ends = gaps.groupBy(key).agg(F.coalesce(F.min(F.when(broken, F.col("_p._t"))), F.max("_t")).alias("_end"))
            news = last.join(ends, key, "left").withColumn("touched", F.coalesce("_end", "touched")).select(*schema.names)
            folders.tick(rows, ts, batch_id)
            if whole_state(batch_id):
                rest = state.join(rows.select(key).distinct(), key, "left_anti")
                news = news.unionByName(rest).where(alive(folders.clock(spark, batch_id + 1), ttl))
            folders.write(news, "state", batch_id)

    return write


def alive(now: Column, ttl: str, idle: str | None = None) -> Column:
    """Whether a state with ``written`` and ``touched`` is alive at a time."""
    fresh = F.col("written") >= now - _span(ttl)
    return fresh if idle is None else fresh & (F.col("touched") >= now - _span(idle))


def fresh(spark: SparkSession, path: str, schema: T.StructType, key: str, columns: Sequence[str], now: Column, ttl: str, idle: str | None = None) -> DataFrame:
    """The states under ``path`` that are alive at ``now``: key, columns, ``written``, ``touched``. ``schema`` is that of the stream's rows."""
    times = [T.StructField(n, T.TimestampNTZType()) for n in ("written", "touched")]
    state = T.StructType([schema[key], *(schema[c] for c in columns), *times])
    rows = BatchFolders(path).read(spark, "state", state)
    rows = rows if "batch_id" in rows.columns else rows.withColumn("batch_id", F.lit(-1))
    return _latest(rows, [key], ["batch_id"]).drop("batch_id").where(alive(now, ttl, idle))


def batch_rate_stream(df: DataFrame, width: str = "1 hour", width_s: float = 3600.0, delay: str = "1 hour", ts: str = "ts",
                      by: Sequence[str] = ()) -> DataFrame:
    """Rows per tumbling window and rate per second; the streaming twin of ``metrics.batch_rate``."""
    return (_watermarked(df, ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", (F.col("n") / F.lit(width_s)).alias("per_second")))
