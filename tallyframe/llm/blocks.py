"""Blocks of documents and the question-and-answer exchange that several operators share.

A block is a few MB of consecutive rows of one scan task, carried as one compressed row. A task
asks questions about the distinct hashes of its block; a question row holds all hashes of one block
that fall into one shard of the hash space. One task per shard answers with one small array per
question row, and the answers meet their block again in a co-group. So a key that occurs in a third
of all rows travels once per block, texts never meet in one task, and no task holds more than one
block or one shard.

The blocks of a frame are cut anew by every job that reads it. They agree as long as the frame is a
plain scan (or any plan with a stable order of rows in stable partitions); each block's id is a
fingerprint of its place and its rows, and a co-group that finds answers for an unknown block fails
rather than returning a wrong result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path, ship_package

from .textcore import mix, signed, text_buffer, tidy

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
BLOCK_SCHEMA = "block long, payload binary"
QUESTION_SCHEMA = "shard long, block long, question binary"
ANSWER_SCHEMA = "block long, shard long, answer binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any types as one compressed value."""
    table = pa.table({str(i): pa.array([a.tobytes()], pa.large_binary()) for i, a in enumerate(arrays)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def unpack(value: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value, max_output_size=1 << 31)
    with pa.ipc.open_stream(raw) as r:
        row = r.read_all()
    return [np.frombuffer(row.column(i)[0].as_py(), t) for i, t in enumerate(types)]


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array of uint64: the differences, byte plane by byte plane, compressed."""
    d = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(value: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(value, max_output_size=1 << 31)
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(d, dtype=np.uint64)


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def load(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload, max_output_size=1 << 32)) as r:
        return r.read_all().combine_chunks().to_batches()[0]


def cut(batches: Iterator[pa.RecordBatch], text: str, target: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of one task, each with its id."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held: list[pa.RecordBatch] = []
    size = serial = 0

    def flush():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        buf, off = text_buffer(batch.column(text))
        seed = np.array([part, serial, batch.num_rows, len(buf), int(buf[::4097].sum(dtype=np.uint64)) if len(buf) else 0], np.uint64)
        h = np.uint64(0)
        for x in seed:
            h = mix(np.array([h ^ x]) + np.uint64(0x51))[0]
        return int(signed(np.array([h]))[0]), batch

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.add(pc.fill_null(pc.binary_length(batch.column(text)), 0), 64).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < n:
            ends = np.cumsum(sizes[at:])
            take = int(np.searchsorted(ends, target - size, "right"))
            if take == 0 and not held:
                take = 1
            if take:
                held.append(batch.slice(at, take))
                size += int(ends[take - 1])
                at += take
            if at < n:
                yield flush()
                held, size, serial = [], 0, serial + 1
    if held:
        yield flush()
    del held
    tidy()


def blocks(df: DataFrame, text: str = "text", target: int = BLOCK_BYTES) -> DataFrame:
    """``df`` as block rows; ``payload`` holds all columns of the block's rows."""

    def run(batches):
        for block, batch in cut(batches, text, target):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dump(batch)], pa.binary())], ["block", "payload"])

    return df.mapInArrow(run, BLOCK_SCHEMA)


def shards_for(total_bytes: int, per_shard: int = SHARD_BYTES) -> int:
    """Number of shards for a volume of text: grows with it, so that a shard's size does not."""
    return max(8, -(-int(total_bytes) // per_shard))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def shard_edges(n: int) -> np.ndarray:
    """Where shards 1..n-1 begin in the space of 64-bit hashes."""
    return np.array([-((-i << 64) // n) for i in range(1, n)], np.uint64)


def split_sorted(values: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(shard, slice) of each shard that a sorted array of hashes has values in."""
    if not len(values):
        return
    if n <= 4 * len(values):
        at = np.concatenate([[0], np.searchsorted(values, shard_edges(n)), [len(values)]])
        for s in np.flatnonzero(np.diff(at)):
            yield int(s), slice(int(at[s]), int(at[s + 1]))
    else:
        shards = [v * n >> 64 for v in values.tolist()]
        at = [0, *(i for i in range(1, len(shards)) if shards[i] != shards[i - 1]), len(shards)]
        for a, b in zip(at, at[1:], strict=False):
            yield shards[a], slice(a, b)


def question_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, block, question = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(question, pa.binary())], ["shard", "block", "question"])


def answer(questions: DataFrame, resolve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """One answer row per question row: ``resolve`` gets all questions of one shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        out = resolve(table.column("question").to_pylist())
        tidy()
        return pa.table([table.column("block"), table.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "answer"])

    return questions.groupBy("shard").applyInArrow(run, ANSWER_SCHEMA)


def meet(blocks_df: DataFrame, answers: DataFrame, run: Callable[[int, Any, dict[int, bytes]], pa.Table], schema, read: Callable[[bytes], Any] = load) -> DataFrame:
    """Each block, its payload as ``read`` gives it, with its answers by shard, given to ``run``."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError(f"answers for a block that occurs {left.num_rows} times: the input's rows are not in a stable order")
        got = dict(zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True)) if right.num_rows else {}
        out = run(left.column("block")[0].as_py(), read(left.column("payload")[0].as_py()), got)
        tidy()
        return out

    return blocks_df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives executors, and has a known size."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, and bound what they get at once.

    Scans are split for a fixed number of tasks instead of the cores there happen to be, so that later
    scans of an input agree with earlier ones when executors are lost or added meanwhile."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def joined(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def parted(value: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(value[:8], "little")
    return value[8: 8 + n], value[8 + n:]


def flags_of(values: np.ndarray, n_shards: int, got: dict[int, bytes], read: Callable[[bytes, int], np.ndarray]) -> np.ndarray:
    """The answers to sorted distinct values, put together from those of their shards."""
    out = np.zeros(len(values), np.uint8)
    for shard, part in split_sorted(values, n_shards):
        if shard not in got:
            raise RuntimeError("a question without an answer: the input's rows are not in a stable order")
        out[part] = read(got[shard], part.stop - part.start)
    return out


def bits(value: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(value, np.uint8))[:n]
