"""Token counts of documents from the pieces of distinct pre-tokens (operator 9).

A byte-level BPE tokenizer encodes each pre-token by itself, so a text's count is the sum of its
pre-tokens' counts. Each block of documents asks for its distinct pre-tokens; one task per shard of
the hash space counts the pieces of every distinct pre-token once; and the answers meet the
block's table of (document, pre-token, frequency). No ids are kept and no text is shuffled: the
frequencies refer to pre-tokens by their place in the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (BLOCK_SCHEMA, QUESTION_SCHEMA, answer, cut, dump, joined, load, meet, pack, pack_sorted, parted, prepare, question_batch,
                     shards_for, split_sorted, text_bytes, unpack, unpack_sorted)
from .pretokens import Pretokens, definition, tokenizer
from .textcore import span_hashes


def _words(question: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the pre-tokens of a question."""
    lengths, flat = unpack(question, np.int32, np.uint8)
    return flat, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return buf[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def count_tokens(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ``n_bytes``, ``n_tokens``) for every row of ``df``, by the tokenizer file at ``path``.

    Without begin, end or added special tokens; special strings inside a text count as the library
    takes them by default. A null text is empty, and an empty one has no tokens. Rows with equal or
    null keys are counted each by itself. Other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    made = definition(spark, path)
    df = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    n_shards = shards_for(text_bytes(df, text))

    def ask(batches):
        tk = tokenizer(made.value)
        for block, batch in cut(batches, text):
            p = Pretokens(batch.column(text), tk)
            h, first = np.unique(p.hashes, return_index=True)
            buf = np.frombuffer(p.raw, np.uint8)
            yield question_batch([(s, block, pack((p.end - p.start)[first[at]].astype(np.int32), _gathered(buf, p.start[first[at]], p.end[first[at]])))
                                  for s, at in split_sorted(h, n_shards)])

    def resolve(questions: list[bytes]) -> list[bytes]:
        tk = tokenizer(made.value)
        parts = [_words(q) for q in questions]
        hashes = [span_hashes(flat, off[:-1], off[1:]) for flat, off in parts]
        known = np.unique(np.concatenate(hashes))
        pieces = np.zeros(len(known), np.int64)  # every pre-token has one piece or more
        out = []
        for (flat, off), h in zip(parts, hashes, strict=True):
            at = np.searchsorted(known, h)
            new = np.flatnonzero(pieces[at] == 0)
            raw = flat.tobytes()
            pieces[at[new]] = tk.counts([raw[a:b] for a, b in zip(off[new].tolist(), off[new + 1].tolist(), strict=True)])
            out.append(pack(pieces[at].astype(np.uint32)))
        return out

    def frequencies(batches):
        tk = tokenizer(made.value)
        for block, batch in cut(batches, text):
            p = Pretokens(batch.column(text), tk)
            h, own = np.unique(p.hashes, return_inverse=True)
            row = np.repeat(np.arange(batch.num_rows), np.diff(p.first))
            pairs, often = np.unique(row * max(1, len(h)) + own, return_counts=True)
            rows = pa.RecordBatch.from_pydict({key: batch.column(key), "n_bytes": p.bytes})
            payload = joined(dump(rows), joined(pack_sorted(h), joined(pack_sorted(pairs.astype(np.uint64)), pack(often.astype(np.uint32)))))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

    def read(payload: bytes):
        rows, rest = parted(payload)
        h, rest = parted(rest)
        pairs, often = parted(rest)
        return load(rows), unpack_sorted(h), unpack_sorted(pairs).astype(np.int64), unpack(often, np.uint32)[0].astype(np.int64)

    def total(block, held, got):
        rows, h, pairs, often = held
        pieces = np.zeros(len(h), np.int64)
        for s, at in split_sorted(h, n_shards):
            pieces[at] = unpack(got[s], np.uint32)[0]
        n = np.zeros(rows.num_rows, np.int64)
        if len(h):
            np.add.at(n, pairs // len(h), often * pieces[pairs % len(h)])
        return pa.table({key: rows.column(key), "n_bytes": rows.column("n_bytes"), "n_tokens": n})

    answers = answer(df.mapInArrow(ask, QUESTION_SCHEMA), resolve)
    return meet(df.mapInArrow(frequencies, BLOCK_SCHEMA), answers, total, f"`{key}` long, n_bytes long, n_tokens long", read)
