"""Substring dedup by repeated-phrase automata (operator 2).

A window is ``window`` consecutive words of one document. Words covered by a window whose word
sequence also starts earlier (smaller id, or same document and earlier start) are removed.

1. Every window has an anchor: the rare-hash phrase of ``ANCHOR`` words with the smallest hash in it.
   Equal windows have equal anchors, and there are about an eighth as many anchors as words. Anchors
   that occur at two places or more are found by a sharded exchange of hashes (see ``blocks``).
2. Windows over a recurring anchor are candidates; a second exchange confirms, by 128-bit hashes,
   which of them recur and whether their first occurrence lies in the asking block.
3. Each block compiles the anchors of its confirmed passages, each once, into an Aho-Corasick automaton (the
   automata are sharded by block: a block needs the phrases it holds, and no others) and streams all its
   documents through it, many streams in step. Windows around a reported place that are a confirmed passage, by both hashes,
   and do not stand at its first place, lose their words. No word goes that the automaton has not reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import (QUESTION_SCHEMA, answer, bits, blocks, cut, flags_of, joined, meet, pack, pack_sorted, parted, prepare,
                     question_batch, shards_for, split_sorted, text_bytes, unpack, unpack_sorted, written)
from .textcore import Words, mix, text_buffer, window_hashes

WINDOW = 20
ANCHOR = 6
#: Words that the automaton reads one after another; a block's documents are read in streams of so many words, side by side.
STREAM = 128
ADDED = ["n_words", "n_removed", "kept_sha256"]


class Windows:
    """Windows of a batch: ``at`` (first word), their anchors' hashes and two independent hashes."""

    def __init__(self, batch: pa.RecordBatch, text: str, window: int, confirm: bool = True):
        self.buf, self.off = text_buffer(batch.column(text))
        self.words = w = Words(self.buf, self.off)
        self.word_hashes = h = w.hashes()
        n = len(h)
        count = np.diff(w.first)
        left = np.repeat(w.first[1:], count) - np.arange(n)
        self.at = np.flatnonzero(left >= window)
        size = min(ANCHOR, window)
        low = window_hashes(h, size)
        place = np.arange(len(low))
        span, wanted = 1, window - size + 1
        while span < wanted:  # leftmost minimum over ``wanted`` consecutive phrases, by doubling
            step = min(span, wanted - span)
            m = max(0, len(low) - step)
            right = low[step:] < low[:m]
            low, place = np.where(right, low[step:], low[:m]), np.where(right, place[step:], place[:m])
            span += step
        self.anchor, self.place = low[self.at], place[self.at]
        self.hash = window_hashes(h, window)[self.at]
        self.check = window_hashes(mix(h + np.uint64(0x2545F4914F6CDD1D)), window)[self.at] if confirm else None

    def anchors(self) -> np.ndarray:
        """The anchor of every place that is the anchor of some window, once per place."""
        new = np.ones(len(self.at), bool)
        new[1:] = self.place[1:] != self.place[:-1]
        return self.anchor[new]


def _recurring(questions: list[bytes]) -> list[bytes]:
    """Which anchors of each question occur at two places or more, in one block or over blocks."""
    parts = [(unpack_sorted(a), np.unpackbits(np.frombuffer(b, np.uint8))) for a, b in (parted(q) for q in questions)]
    values = np.concatenate([v for v, _ in parts])
    twice = np.concatenate([t[: len(v)] for v, t in parts]).astype(bool)
    distinct, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    more = count > 1
    more[inverse[twice]] = True
    flags, at, out = more[inverse], 0, []
    for v, _ in parts:
        out.append(np.packbits(flags[at: at + len(v)]).tobytes())
        at += len(v)
    return out


def _first_places(questions: list[bytes]) -> list[bytes]:
    """For each asked window 1 if its first place lies in another block, plus 2 if it recurs at all."""
    parts = [(unpack_sorted(a), *unpack(b, np.uint64, np.int64, np.int64, np.uint8)) for a, b in (parted(q) for q in questions)]
    sizes = [len(p[0]) for p in parts]
    h, check, doc, start, twice = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((start, doc, check, h))
    h, check, doc, start, twice = (x[order] for x in (h, check, doc, start, twice))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)[group]
    later = (doc != doc[first]) | (start != start[first])
    flags = np.empty(len(h), np.uint8)
    flags[order] = later + 2 * ((np.bincount(group, minlength=1) > 1)[group] | twice)
    out, at = [], 0
    for n in sizes:
        out.append(pack(flags[at: at + n]))
        at += n
    return out


def _ask_anchors(df: DataFrame, text: str, window: int, n_shards: int) -> DataFrame:
    def run(batches):
        for block, batch in cut(batches, text):
            w = Windows(batch, text, window, confirm=False)
            values, count = np.unique(w.anchors(), return_counts=True)
            yield question_batch([(s, block, joined(pack_sorted(values[p]), np.packbits(count[p] > 1).tobytes())) for s, p in split_sorted(values, n_shards)])

    return df.mapInArrow(run, QUESTION_SCHEMA)


def _candidates(w: Windows, n_shards: int, got: dict[int, bytes]) -> np.ndarray:
    """Indices of the windows whose anchor recurs."""
    values, inverse = np.unique(w.anchor, return_inverse=True)
    return np.flatnonzero(flags_of(values, n_shards, got, bits)[inverse])


class Distinct:
    """The distinct windows among some windows of a block, in order of hash and check: of each its first
    place in the block (``doc``, ``start``), whether it stands there twice, and its anchor (``anchor``, at word ``place``)."""

    def __init__(self, batch: pa.RecordBatch, w: Windows, which: np.ndarray, key: str):
        doc, start = _places(batch, w, which, key)
        h, check = w.hash[which], w.check[which]
        order = np.lexsort((start, doc, check, h))
        h, check = h[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        self.h, self.check, self.doc, self.start = h[first], check[first], doc[order][first], start[order][first]
        self.twice = np.diff(np.append(first, len(order))) > 1
        self.anchor, self.place = w.anchor[which][order][first], w.place[which][order][first]


def _places(batch: pa.RecordBatch, w: Windows, which: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Document id and first word within the document of some windows."""
    row = np.searchsorted(w.words.first, w.at[which], "right") - 1
    ids = batch.column(key).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids[row], (w.at[which] - w.words.first[row]).astype(np.int64)


def _among(h: np.ndarray, check: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where each pair (x, y) stands among the pairs (h, check), which are sorted; -1 where it does not."""
    at, found = np.searchsorted(h, x), np.full(len(x), -1)
    for step in range(np.unique(h, return_counts=True)[1].max(initial=0)):  # one step, unless hashes collide
        p = np.minimum(at + step, len(h) - 1)
        hit = (h[p] == x) & (check[p] == y)
        found[hit] = p[hit]
    return found


def _ask_windows(df: DataFrame, anchors: DataFrame, text: str, key: str, window: int, n_shards: int) -> DataFrame:
    def run(block, batch, got):
        w = Windows(batch, text, window)
        d = Distinct(batch, w, _candidates(w, n_shards, got), key)
        return pa.Table.from_batches([question_batch([
            (s, block, joined(pack_sorted(d.h[p]), pack(d.check[p], d.doc[p], d.start[p], d.twice[p].astype(np.uint8))))
            for s, p in split_sorted(d.h, n_shards)])])

    return meet(blocks(df, text), anchors, run, QUESTION_SCHEMA)


def _spaced(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, each after a space, one more space at the end; and where those spaces stand."""
    lengths = end - start
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = np.full(int(begin[-1]) + 1, 32, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(begin[:-1] + 1, lengths) + within] = buf[np.repeat(start, lengths) + within]
    return flat, begin


class Automaton:
    """Aho-Corasick automaton over words, for phrases (rows of word hashes) of one length.

    States are numbered by depth from the root 0, each the target of one edge. Edges are the sorted numbers
    ``state * alphabet + symbol``, and the edge at index i leads to state i + 1. Symbol 0 is any word of no phrase."""

    def __init__(self, phrases: np.ndarray):
        self.size = phrases.shape[1]
        self.words, symbols = np.unique(phrases, return_inverse=True)
        symbols = symbols.reshape(phrases.shape) + 1
        self.alphabet = len(self.words) + 1
        self.edges, self.fail = np.zeros(0, np.int64), np.zeros(1, np.int64)
        state = np.zeros(len(phrases), np.int64)
        for depth in range(self.size):
            edges, own = np.unique(state * self.alphabet + symbols[:, depth], return_inverse=True)
            if depth:
                fail = self.step(self.fail[edges // self.alphabet], edges % self.alphabet)
            else:
                self.root = np.zeros(self.alphabet, np.int64)
                self.root[edges] = np.arange(1, len(edges) + 1)
                fail = np.zeros(len(edges), np.int64)
            self.accepting = len(self.edges) + 1  # the states from here on are the deepest: whole phrases
            state = own.reshape(-1) + self.accepting
            self.edges, self.fail = np.concatenate([self.edges, edges]), np.concatenate([self.fail, fail])

    def symbols(self, word_hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, word_hashes), len(self.words) - 1)
        return np.where(self.words[at] == word_hashes, at + 1, 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each stream: along the edge, or along the failure links to the first state that has it."""
        out = self.root[symbol]
        on = np.flatnonzero((state > 0) & (symbol > 0))
        state = state[on]
        while len(on):
            edge = state * self.alphabet + symbol[on]
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            found = self.edges[at] == edge
            out[on[found]] = at[found] + 1
            state = self.fail[state]
            on, state = on[left := ~found & (state > 0)], state[left]
        return out

    def places(self, word_hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """First words of all places, in documents that begin at the words ``first``, where a phrase stands.

        Documents are read in streams of ``STREAM`` words, all streams a word at a time; each reads on into the
        next one's words as far as a phrase that begins in it can reach."""
        symbols = self.symbols(word_hashes)
        count = -(-np.diff(first) // STREAM)
        begin = np.repeat(first[:-1] - (np.cumsum(count) - count) * STREAM, count) + np.arange(count.sum()) * STREAM
        length = np.minimum(np.repeat(first[1:], count) - begin, STREAM + self.size - 1)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state, found = np.zeros(len(begin), np.int64), [np.zeros(0, np.int64)]
        for t in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -t))  # streams longer than t
            state = self.step(state[:n], symbols[begin[:n] + t])
            found.append(begin[np.flatnonzero(state >= self.accepting)] + t + 1 - self.size)
        return np.concatenate(found)


def _located(w: Windows, phrases: np.ndarray, size: int) -> np.ndarray:
    """First words of all places where one of the phrases stands, found by an automaton over all documents of the block."""
    return Automaton(w.word_hashes[phrases[:, None] + np.arange(size)]).places(w.word_hashes, w.words.first)


def _kept(batch: pa.RecordBatch, got: dict[int, bytes], text: str, key: str, window: int, n_shards: int) -> tuple[Words, np.ndarray]:
    """The words of a block, and for each whether it stays.

    The answers name the confirmed passages, each once, with its first place; where else they stand is what the
    automaton reports, each place checked against the passages by both hashes."""
    w = Windows(batch, text, window)
    which = _candidates(w, n_shards, {s: v for s, v in got.items() if s < n_shards})
    d = Distinct(batch, w, which, key)
    flags = flags_of(d.h, n_shards, {s - n_shards: v for s, v in got.items() if s >= n_shards}, lambda b, n: unpack(b, np.uint8)[0])
    known = np.flatnonzero(flags >= 2)
    covered = np.zeros(len(w.words.start) + 1, np.int32)
    if len(known):
        size = min(ANCHOR, window)
        phrases = d.place[known[np.unique(d.anchor[known], return_index=True)[1]]]  # every anchor phrase once
        hits = _located(w, phrases, size)
        near = np.zeros(len(w.words.start), bool)
        for back in range(window - size + 1):  # a window holds its anchor anywhere
            near[hits[hits >= back] - back] = True
        which = np.flatnonzero(near[w.at])
        own = _among(d.h[known], d.check[known], w.hash[which], w.check[which])
        which, own = which[own >= 0], known[own[own >= 0]]
        doc, start = _places(batch, w, which, key)
        gone = w.at[which[(flags[own] & 1 == 1) | (doc != d.doc[own]) | (start != d.start[own])]]
        covered[gone] += 1  # the starts are distinct, and so are the ends
        covered[gone + window] -= 1
    return w.words, np.cumsum(covered[:-1]) == 0


def _rewritten(batch: pa.RecordBatch, words: Words, stays: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, list, list[str]]:
    """Per document: words, removed words, text, digest of the kept words."""
    kept = np.flatnonzero(stays)
    flat, begin = _spaced(words.buf, words.start[kept], words.end[kept])
    flat = flat.tobytes()
    first = np.searchsorted(kept, words.first)
    n_words = np.diff(words.first)
    n_removed = n_words - np.diff(first)
    old = batch.column(text).to_pylist()
    texts, digests = [], []
    for i, (a, b) in enumerate(zip(begin[first[:-1]].tolist(), begin[first[1:]].tolist(), strict=True)):
        body = flat[a + 1: b]
        digests.append(hashlib.sha256(body).hexdigest())
        texts.append(old[i] if not n_removed[i] else body.decode("utf-8", "replace"))
    return n_words, n_removed, texts, digests


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``df`` with its repeated passages removed, plus ``n_words``, ``n_removed`` and ``kept_sha256``.

    A text from which nothing is removed stays as it is; of another the kept words remain, joined by
    one space. Null texts hold no words and stay null; a null id comes before all others. Rows of one
    id are one document: equal places in them do not count as earlier. Columns of ``df`` with the
    names of the added ones are replaced. ``df`` must be a scan or another plan with rows in stable
    order (see ``blocks``).
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop(*(c for c in ADDED if c not in (text, key)))
    n_shards = shards_for(text_bytes(df, text))
    slim = df.select(key, text)
    anchors = written(spark, answer(_ask_anchors(slim, text, window, n_shards), _recurring), "anchors")
    windows = answer(_ask_windows(slim, anchors, text, key, window, n_shards), _first_places)
    names = df.columns

    def run(block, batch, got):
        words, stays = _kept(batch, got, text, key, window, n_shards)
        n_words, n_removed, texts, digests = _rewritten(batch, words, stays, text)
        made = {text: pa.array(texts, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({c: made.get(c, batch.column(c) if c in names else None) for c in [*names, *ADDED]})

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType() if c == "kept_sha256" else T.LongType()) for c in ADDED)])
    return meet(blocks(df, text), anchors.unionByName(windows.withColumn("shard", F.col("shard") + n_shards)), run, schema)
