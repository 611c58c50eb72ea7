"""Base-58 text of bytes (F12) as limb arithmetic in Catalyst expressions.

The bytes are read as digits of 24 bits. A digit's weight, a power of two, is a constant vector of base-58**5 limbs, so the
number's limbs are sums of products, each under 2**58 for 64 bytes; one pass carries them, and a limb is five characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.expr import BASE58_ALPHABET, _c

SIGNATURE_BYTES = 64
LIMB_DIGITS = 5
LIMB = len(BASE58_ALPHABET) ** LIMB_DIGITS
CHUNK_BITS = 24


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` names it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _weights(width: int) -> list[list[int]]:
    """Per limb, lowest first, its part in the weight of every chunk, highest chunk first."""
    n_chunks = -(-width * 8 // CHUNK_BITS)
    powers = [1 << (CHUNK_BITS * i) for i in reversed(range(n_chunks))]
    limbs = []
    while any(powers):
        limbs.append([p % LIMB for p in powers])
        powers = [p // LIMB for p in powers]
    # the sum of all chunks can reach one limb more than the highest weight has
    return [*limbs, [0] * n_chunks]


def base58_encode(c, width: int = SIGNATURE_BYTES) -> Column:
    """bytes -> base-58 text; each leading zero byte is a 1. Null gives null, no bytes give ''.

    ``width`` is the most bytes a value has, 64 at most; a longer value fails the query rather than lose bytes."""
    if not 0 < width <= SIGNATURE_BYTES:
        raise ValueError(f"width must be 1 to {SIGNATURE_BYTES}")
    raw = _c(c)
    digits = CHUNK_BITS // 4
    n_chunks = -(-width * 8 // CHUNK_BITS)
    weights = F.array(*(F.array(*(F.lit(w).cast("long") for w in row)) for row in _weights(width)))
    alphabet = F.lit(BASE58_ALPHABET)
    zero = F.lit(0).cast("long")

    def characters(limb: Column) -> Column:
        powers = [len(BASE58_ALPHABET) ** i for i in reversed(range(LIMB_DIGITS))]
        return F.concat(*(F.substr(alphabet, (F.call_function("div", limb, F.lit(p)) % len(BASE58_ALPHABET)).cast("int") + 1, F.lit(1)) for p in powers))

    def carried(state: Column, total: Column) -> Column:
        return _bound(total + state["carry"], lambda v: F.struct(F.call_function("div", v, F.lit(LIMB)).alias("carry"),
                                                                F.concat(characters(v % LIMB), state["text"]).alias("text")))

    def text(hexed: Column) -> Column:
        padded = F.lpad(hexed, n_chunks * digits, "0")
        chunks = F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda i: F.conv(F.substr(padded, i * digits + 1, F.lit(digits)), 16, 10).cast("long"))
        totals = _bound(chunks, lambda v: F.transform(weights, lambda w: F.aggregate(F.zip_with(w, v, lambda x, y: x * y), zero, lambda a, x: a + x)))
        number = F.aggregate(totals, F.struct(zero.alias("carry"), F.lit("").alias("text")), carried, lambda s: s["text"])
        zeros = F.length(F.regexp_extract(hexed, "^(00)*", 0)) / 2
        return F.concat(F.repeat(F.lit("1"), zeros.cast("int")), F.regexp_replace(number, "^1+", ""))

    too_long = F.raise_error(F.concat(F.lit(f"base58_encode: more than {width} bytes: "), F.length(raw).cast("string")))
    return F.when(F.length(raw) > width, too_long.cast("string")).otherwise(_bound(F.hex(raw), text))
