"""Vectorised text helpers for code inside Arrow tasks: words, word hashes and window hashes over UTF-8 bytes.

A batch of texts is handled as one byte buffer with document offsets, as Arrow stores it. All
functions are pure numpy, so a batch costs a few passes over its bytes whatever its rows are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the byte, word and window hashes, and the two constants of the 64-bit finaliser.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand and kept per process."""

    def __init__(self, base: np.uint64):
        self.base = base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]),
                                             dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(BYTE_BASE), _Powers(WORD_BASE)

#: Bytes that separate words ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z on bytes; all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1) of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str, target: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``target`` bytes of text each (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + target, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a buffer of documents: byte spans, and ``first`` (n_docs + 1), the word range of each document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE):
        inside = ~white[buf]
        n = len(buf)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = off[(off > 0) & (off < n)]
        before[edges], after[edges - 1] = False, False
        self.buf = buf
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each byte span (in order of start); equal bytes give equal hashes wherever they stand.

    Works through the buffer in stretches, so that its memory is a few times a stretch or the longest span."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + stretch)))
        low, high = int(start[at]), int(end[at:to].max())
        up, down = _BYTE_POWERS.upto(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[buf[low:high]] * up[:-1], out=total[1:])
        a, b = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values of ``h`` (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values of ``h`` in each range; equal sequences give equal hashes."""
    up, down = _WORD_POWERS.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def tidy() -> None:
    """Give memory that this worker has freed back to the system: idle workers wait for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)
