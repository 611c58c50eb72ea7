"""Seen keys against a very large store: a stored, mergeable Bloom filter per time range.

A filter is a table of 256-bit blocks, ``(range, block, w0, w1, w2, w3)``. A key sets one bit in each word of one block, so a
look-up is an equi-join on the block and four masks, and filters of parts of the data merge by ``bit_or``. A range has at most
``blocks`` blocks of 48 bytes, whatever it holds. Up to ``LOOKUP_BYTES`` by that bound, the filter is broadcast; a larger one is
joined without a hint. A fuller filter lets more keys through, never fewer: what it holds is verified by a join on the keys, so
results are exact at every load. Ranges let a store drop its oldest days, and build the newest alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE, BLOCK = "range", "block"
WORDS = ("w0", "w1", "w2", "w3")
#: Blocks of one range: 12 MB of rows, for some 4 million keys at a share of about 1 in 300 let through wrongly.
BLOCKS = 1 << 18
#: Largest filter that is broadcast, by ``blocks``; beyond it Spark's own choice of a join takes over.
LOOKUP_BYTES = 1 << 28
BLOCK_BYTES = 8 * (len(WORDS) + 2)


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(blocks))


def _masks(keys: Sequence[str]) -> list[Column]:
    """One bit of each word, of six bits each of a second hash."""
    h = F.xxhash64(*keys, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(len(WORDS))]


def build_filter(seen: DataFrame, keys: Sequence[str], time_range: Column, blocks: int = BLOCKS) -> DataFrame:
    """The filter of the rows of ``seen``; rows with a null key are in none, since they equal no other. Rows combine before the
    shuffle to at most ``blocks`` a range and task. Every look-up and merge must use the same ``blocks``."""
    rows = seen.where(_known(keys)).select(time_range.cast("long").alias(RANGE), _block(keys, blocks).alias(BLOCK),
                                           *(m.alias(w) for m, w in zip(_masks(keys), WORDS, strict=True)))
    return merge_filters(rows)


def merge_filters(*filters: DataFrame) -> DataFrame:
    """One filter of all keys that any of the filters holds."""
    rows = filters[0]
    for other in filters[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy(RANGE, BLOCK).agg(*(F.bit_or(w).alias(w) for w in WORDS))


def _known(keys: Sequence[str]) -> Column:
    out = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        out = out & F.col(k).isNotNull()
    return out


def maybe_seen(current: DataFrame, held: DataFrame, keys: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """``current`` with ``_maybe``: whether the filter ``held``, of any ranges, has the key. Where the filter is broadcast, no row of
    ``current`` is shuffled. ``current`` has no columns ``_block``, ``_maybe``, ``_w0`` to ``_w3``."""
    words = {w: f"_{w}" for w in WORDS}
    side = held.groupBy(F.col(BLOCK).alias("_block")).agg(*(F.bit_or(w).alias(n) for w, n in words.items()))  # at most ``blocks`` rows
    if blocks * BLOCK_BYTES <= LOOKUP_BYTES:
        side = F.broadcast(side)
    probed = current.withColumn("_block", F.when(_known(keys), _block(keys, blocks))).join(side, "_block", "left")
    hit = F.lit(True)
    for mask, name in zip(_masks(keys), words.values(), strict=True):
        hit = hit & (F.col(name).bitwiseAND(mask) != 0)
    return probed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_block", *words.values())


def new_keys(current: DataFrame, seen: DataFrame, held: DataFrame, keys: Sequence[str] = ("address", "signature"),
             blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``current`` whose keys are not in ``seen``, exactly as a left anti join gives them.

    ``held`` is a filter of ``seen`` made with the same ``blocks``, or of more rows than those. Rows it does not hold are new and
    take no part in the join. The rest are joined with the rows of ``seen`` that a filter of theirs holds, so neither side is
    shuffled whole. ``current`` is read three times; null keys are new; repeated rows stay.
    """
    keys = list(keys)
    probed = maybe_seen(current, held, keys, blocks)
    open_rows = probed.where("_maybe").drop("_maybe")
    asked = build_filter(open_rows, keys, F.lit(0), blocks)
    candidates = maybe_seen(seen.select(*keys), asked, keys, blocks).where("_maybe").select(*keys)
    return probed.where(~F.col("_maybe")).drop("_maybe").unionByName(open_rows.join(candidates, keys, "left_anti").select(current.columns))
