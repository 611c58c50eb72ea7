"""Packing of documents into sequences: first-fit decreasing with a tournament tree (operator 8).

Each task cuts its documents' token ids into pieces of at most one sequence and gives every piece a
random group. A group is packed by itself: longest piece first, each into the first bin that has
room, found by a tournament tree of the bins' free capacities in logarithmic time. The number of
groups grows with the rows, so a group's size does not. Only lengths and checksums are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import prepare
from .pretokens import Pretokens, definition, tokenizer
from .textcore import chunks, mix, tidy

GROUP_ROWS = 4096
GROUP_BITS = 24  # sequences of one group have ids group * 2**GROUP_BITS + n
CHUNK_BYTES = 2 << 20


class Bins:
    """Tournament tree over the free capacities of bins: each inner node holds the larger of its two."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Places an item into the first bin with room, and gives its number."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        place = node - self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return place


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset within the bin) of items no longer than ``capacity``."""
    bins = Bins(len(lengths), capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    filled = [0] * len(lengths)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        b = bins.put(n)
        where[i], offset[i] = b, filled[b]
        filled[b] += n
    return where, offset


def pack_sequences(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id",
                   seed: int = 17, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with their places: (key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``).

    A document is its ids by the tokenizer file at ``path``, then ``end_id``; it is cut after every
    ``capacity`` ids. A null or empty text is the end id alone. Rows with equal or null keys are
    documents of their own. Other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    made = definition(spark, path)
    df = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    n_groups = max(1, -(-df.count() // group_rows))

    def pieces(batches):
        tk = tokenizer(made.value)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for part in chunks(batch, text, CHUNK_BYTES):
                p = Pretokens(part.column(text), tk)
                flat, length = tk.ids(p)
                at = np.concatenate([[0], np.cumsum(length)])[p.first]
                rows, starts, sizes, sums, totals = [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        piece = ids[s: s + capacity]
                        rows.append(i)
                        starts.append(s)
                        sizes.append(len(piece))
                        sums.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                group = mix(np.arange(serial, serial + len(rows), dtype=np.uint64) ^ mix(np.array([seed]))) % np.uint64(n_groups)
                serial += len(rows)
                tidy()
                yield pa.RecordBatch.from_pydict({"group": group.astype(np.int64), key: part.column(key).take(pa.array(rows, pa.int64())), "start": pa.array(starts, pa.int64()),
                                                  "length": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": pa.array(totals, pa.int64())})

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ids_crc32", "ascending"), (key, "ascending"), ("start", "ascending")])
        where, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("group")[0].as_py()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << GROUP_BITS) + where)).append_column("offset", pa.array(offset))

    cut = f"`{key}` long, start long, length long, ids_crc32 long, doc_tokens long"
    return df.mapInArrow(pieces, "group long, " + cut).groupBy("group").applyInArrow(packed, cut + ", sequence_id long, offset long")
