"""Merkle manifest of a dataset as a tree of SHA-256 midstates (operator 13).

A leaf is the digest of a row's encoded columns. The leaves of one source, in order of their id, are
the lowest level of its tree; every 16 consecutive nodes become the node above them, until one is
left, the source's subroot. The subroots in order of source are the leaves of the tree of the root.

* A parent keeps a copy of its hash state from before each child slot. What the tree would be with
  another leaf follows by folding: the state before the leaf's slot is resumed with the replacement
  and the siblings to its right only, and so on with the result, parent by parent.
* Trees are built in groups of ``SPAN`` consecutive nodes, ``HEIGHT`` levels a job, and walked down
  again in the same groups. What a group needs of all levels above it is one row: for each of
  its ancestors' slots the digests to the left, of which it makes the state once, and those to the right.
  So a task holds one group, a source may have any number of rows, and rows travel as digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import prepare, written
from .ordering import in_order, with_places

ARITY = 16
HEIGHT = 2
SPAN = ARITY ** HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node: its tree, its place in its level, the number of nodes of that level, and its digest in hexadecimal.
NODE = "tree string, place long, n long, digest string"
#: What lies beside the way from a node up to the end of its tree, and of those above it: digests to the left and to the right, level by level.
PATH = "tree string, place long, lefts array<string>, rights array<string>, subroot string, root string"


def encoded(value: Column) -> Column:
    """A value as its length in bytes, a colon, and the value; a null as a hyphen."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


class Parent:
    """A node of the tree with its children's digests and the hash states before each of their slots."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, replacement: bytes) -> bytes:
        """The digest this node would have with another child in a slot."""
        return resumed(self.states[slot], replacement, b"".join(self.children[slot + 1:]))

    def beside(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1:])


def resumed(state, replacement: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


def height(n: int) -> int:
    """Levels that a group of a level of n nodes builds."""
    levels = 0
    while n > 1 and levels < HEIGHT:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def grow(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """The parents of a group of consecutive nodes, level by level."""
    out: list[list[Parent]] = []
    for _ in range(levels):
        out.append([Parent(digests[at: at + ARITY]) for at in range(0, len(digests), ARITY)])
        digests = [p.digest for p in out[-1]]
    return out


def _group(table: pa.Table) -> tuple[pa.Table, list[bytes], list[list[Parent]]]:
    table = table.sort_by("place")
    digests = [d.encode() for d in table.column("digest").to_pylist()]
    return table, digests, grow(digests, height(table.column("n")[0].as_py()))


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / SPAN).cast("long"))


def _above(nodes: DataFrame) -> DataFrame:
    """The nodes ``HEIGHT`` levels up (fewer where a tree ends)."""

    def run(table: pa.Table) -> pa.Table:
        block, n = table.column("block")[0].as_py(), table.column("n")[0].as_py()
        tree = table.column("tree")[0].as_py()
        _, digests, levels = _group(table)
        top = levels[-1][0].digest if levels else digests[0]
        return pa.table({"tree": [tree], "place": [block], "n": [-(-n // SPAN)], "digest": [top.decode()]})

    return _blocked(nodes.select("tree", "place", "n", "digest")).groupBy("tree", "block").applyInArrow(run, NODE)


def _climb(spark: SparkSession, nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and what is above them, group level by group level, up to one node a tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        levels.append(written(spark, _above(levels[-1]), f"{name}-{len(levels)}"))
    return levels


def _paths_in(levels: list[list[Parent]], at: int):
    """(left, right) digests beside a node of a group, level by level."""
    for parents in levels:
        parent, slot = parents[at // ARITY], at % ARITY
        yield b"".join(parent.children[:slot]), b"".join(parent.children[slot + 1:])
        at //= ARITY


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of ``nodes`` from those of the nodes above."""

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, _, levels = _group(table)
        up = above.to_pylist()[0]
        mine = [list(_paths_in(levels, i)) for i in range(table.num_rows)]
        lefts, rights = ([[side[i].decode() for side in path] for path in mine] for i in (0, 1))
        return pa.table({"tree": table.column("tree"), "place": table.column("place"),
                         "lefts": pa.array([x + up["lefts"] for x in lefts], pa.list_(pa.string())),
                         "rights": pa.array([x + up["rights"] for x in rights], pa.list_(pa.string())),
                         "subroot": pa.array([up["subroot"]] * len(mine), pa.string()), "root": pa.array([up["root"]] * len(mine), pa.string())})

    above = paths.withColumnRenamed("place", "block")
    return _blocked(nodes.select("tree", "place", "n", "digest")).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, PATH)


def _folded(leaves: DataFrame, paths: DataFrame, key: str, key_type: str) -> DataFrame:
    """Each leaf with its proof and the root that its replacement folds to."""
    schema = f"{key} {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table, digests, levels = _group(table)
        up = above.to_pylist()[0]
        # one state and the right siblings for each slot above the group; and all that stands beside the way from each parent on
        higher = [(hashlib.sha256(left.encode()), right.encode()) for left, right in zip(up["lefts"], up["rights"], strict=True)]
        rest = "".join(a + b for a, b in zip(up["lefts"], up["rights"], strict=True)).encode()
        besides = [[rest]]
        for parents in reversed(levels):
            besides.append([parents[i // ARITY].beside(i % ARITY) + besides[-1][i // ARITY] for i in range(sum(len(p.children) for p in parents))])
        proofs, folded = [], []
        for i, node in enumerate(table.column("replacement").to_pylist()):
            node, at = node.encode(), i
            for parents in levels:
                node, at = parents[at // ARITY].folded(at % ARITY, node), at // ARITY
            for state, right in higher:
                node = resumed(state, node, right)
            folded.append(node.decode())
            proofs.append(hashlib.sha256(besides[-1][i]).hexdigest())
        n = table.num_rows
        return pa.table([table.column(key), table.column("digest"), pa.array([up["subroot"]] * n), pa.array([up["root"]] * n), pa.array(proofs), pa.array(folded)],
                        names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    above = paths.withColumnRenamed("place", "block")
    return _blocked(leaves).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def manifest(df: DataFrame, replacements: Mapping[str, Column] | None = None, columns: Sequence[str] = COLUMNS, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``) for every row of ``df``.

    ``columns`` make the leaves, in this order. ``replacements`` gives other values of some of them, in
    terms of ``df``'s columns, for what is to be verified against the manifest: the root is folded from a leaf with
    these, and is verified when it equals the root. A proof is the digest of all siblings, level by level.

    A null has an encoding of its own; rows of a null source are a tree, the first one. Rows without a
    key come first in their source. Rows of one key are all leaves, ordered by their digests. An empty table has no rows
    and no root. Other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    replacements = dict(replacements or {})
    tree = F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    stored = written(spark, df.select(F.col(key).alias(key), tree.alias("tree"), leaf([F.col(c) for c in columns]).alias("digest"),
                                      leaf([replacements.get(c, F.col(c)) for c in columns]).alias("replacement")), "leaves")
    rows = in_order(spark, stored, ["tree", key, "digest", "replacement"], "ordered")
    leaves = written(spark, with_places(spark, rows, "tree", "place", "n"), "placed")
    levels = _climb(spark, leaves.select("tree", "place", "n", "digest"), "nodes")

    # the tree over the subroots
    subroots = in_order(spark, levels[-1].select(F.col("tree").alias("of"), "digest", F.lit("").alias("tree")), ["tree", "of"], "subroots")
    tops = _climb(spark, written(spark, with_places(spark, subroots, "tree", "place", "n"), "tops"), "tops")
    empty = F.array().cast("array<string>")
    end = tops[-1].select("tree", "place", empty.alias("lefts"), empty.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(tops[:-1]):
        end = written(spark, _descend(level, end), "paths")
    paths = tops[0].join(end.drop("tree", "subroot"), "place").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    # and down the trees of the sources
    for level in reversed(levels[1:-1]):
        paths = written(spark, _descend(level, paths), "paths")
    return _folded(leaves, paths, key, dict(stored.dtypes)[key]).withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z to a-z; all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
