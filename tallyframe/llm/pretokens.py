"""Pre-tokens of a byte-level BPE tokenizer, cut for a whole batch at once, and the ids of distinct pre-tokens.

The cutting rule of byte-level BPE: a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of
digits or of other signs, each with one space before it if there is one; of white space before
something else, all but the last character, then that one; and white space at the end of a text.
Which characters are letters, digits or white space is asked of the library itself, once per character.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .textcore import span_hashes, text_buffer

LETTER, DIGIT, OTHER, SPACE = 1, 2, 3, 4


class Tokenizer:
    """The library's tokenizer of one file, with what a task asks of it. Kept once per process (``tokenizer``)."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_buffer(definition)
        self.kinds = np.zeros(0x110000, np.uint8)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self):
        """Forget the ids of pre-tokens seen so far."""
        self.seen = np.zeros(0, np.uint64)
        self.place, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if not kinds.all():
            cut = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(codes[kinds == 0]).tolist():
                self.kinds[c] = next((kind for kind, lead in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")) if len(cut(lead + chr(c))) == 1), SPACE)
            kinds = self.kinds[codes]
        return kinds

    def _encoded(self, words: list[bytes], step: int = 8192):
        """The library's encodings of pre-tokens, a bounded number at a time: they are large objects."""
        for at in range(0, len(words), step):
            yield from self.library.encode_batch([w.decode() for w in words[at: at + step]], add_special_tokens=False)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._encoded(words)]

    def ids(self, pieces: Pretokens, keep: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, length by pre-token) of all pre-tokens of a batch; at most ``keep`` distinct ones stay in memory."""
        h, first, own = np.unique(pieces.hashes, return_index=True, return_inverse=True)
        if len(self.seen) + len(h) > keep:
            self.reset()
        at = np.searchsorted(self.seen, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.seen)
        new[inside] = self.seen[at[inside]] != h[inside]
        if new.any():
            made = self.encode([pieces.raw[a:b] for a, b in zip(pieces.start[first[new]].tolist(), pieces.end[first[new]].tolist(), strict=True)])
            length = np.fromiter(map(len, made), np.int64, len(made))
            place = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, *made])
            seen = np.concatenate([self.seen, h[new]])
            order = np.argsort(seen, kind="stable")
            self.seen, self.place, self.length = seen[order], np.concatenate([self.place, place])[order], np.concatenate([self.length, length])[order]
            at = np.searchsorted(self.seen, h)
        length, place = self.length[at][own], self.place[at][own]
        total = int(length.sum())
        flat = self.flat[np.repeat(place - (np.cumsum(length) - length), length) + np.arange(total)]
        return flat, length


    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each pre-token."""
        return np.fromiter(map(len, self._encoded(words)), np.int64, len(words))


_KEPT: dict[int, Tokenizer] = {}


def tokenizer(definition: bytes) -> Tokenizer:
    """The tokenizer of a definition file's content; its ids of pre-tokens are kept between tasks of a process."""
    if hash(definition) not in _KEPT:
        _KEPT[hash(definition)] = Tokenizer(definition)
    return _KEPT[hash(definition)]


def definition(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (a few MB, whatever the data) for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Pretokens:
    """Pre-tokens of a batch of texts: byte spans in ``raw``, hashes, and ``first`` (n + 1), each document's range."""

    def __init__(self, column: pa.Array, tk: Tokenizer):
        buf, off = text_buffer(column)
        raw = buf.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8 stand for the replacement character
            parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            raw = b"".join(parts)
            buf, text = np.frombuffer(raw, np.uint8), raw.decode()
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(codes)
        where = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # byte of each character
        edge = np.zeros(n + 2, bool)  # a text, or a special string, begins here
        edge[np.searchsorted(where, off)] = True
        special = []
        for s in tk.specials:
            at = raw.find(s)
            while at >= 0:
                a, b = np.searchsorted(where, [at, at + len(s)]).tolist()
                if not edge[a + 1: b].any():
                    special.append((a, b))
                at = raw.find(s, at + len(s))
        for a, b in special:
            edge[[a, b]] = True
        edge = edge[: n + 1]
        edge[n] = True
        kind = tk.classes(codes) if n else np.zeros(0, np.uint8)
        begins = np.ones(n + 1, bool)
        begins[1:n] = (kind[1:] != kind[:-1]) | edge[1:n] if n else True
        blank = kind == SPACE
        space = blank & (codes == 0x20)
        start = begins[:n].copy()
        # the last white space before something else stands for itself, or goes with it if it is a space
        last = np.flatnonzero(blank & begins[1:] & ~edge[1:])
        start[last] = True
        start[last[space[last]] + 1] = False
        # contractions: a lone apostrophe that begins a pre-token
        c = np.append(codes, np.zeros(3, np.uint32))
        mark = np.flatnonzero(start & (codes == 0x27))
        mark = mark[~edge[mark + 1]] if len(mark) else mark
        one = mark[np.isin(c[mark + 1], np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]
        two = mark[~edge[np.minimum(mark + 2, n)]] if len(mark) else mark
        two = two[((c[two + 1] == ord("r")) & (c[two + 2] == ord("e"))) | ((c[two + 1] == ord("v")) & (c[two + 2] == ord("e"))) | ((c[two + 1] == ord("l")) & (c[two + 2] == ord("l")))]
        for group, size in ((one, 1), (two, 2)):
            start[group + 1] = False
            rest = group + 1 + size
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~edge[rest]]] = True
        for a, b in special:
            start[a:b] = False
            start[a] = True
            if b < n:
                start[b] = True
        at = where[np.flatnonzero(start)]
        self.raw, self.start, self.end = raw, at, np.append(at[1:], len(buf))
        self.first = np.searchsorted(at, off)
        self.bytes = np.diff(off)
        self.hashes = span_hashes(buf, self.start, self.end) if len(at) else np.zeros(0, np.uint64)
