"""Exact top-k search by inner product over a paged M-tree (operator 3).

Scores are integer inner products of quantised vectors. With M the largest norm, adding the coordinate
sqrt(M^2 - |x|^2) to a stored vector and 0 to a query makes distances that order as the scores do:
d(q, x)^2 = |q|^2 + M^2 - 2 q.x. In that metric space the rows are dealt to the nearest of a bounded
number of routing objects, and pages of ``PAGE_ROWS`` rows of one cell become the tree's subtrees, each
a stored row: leaf nodes with a pivot, a covering radius and the distance to the routing object, and
entries with the distance to their leaf's pivot.

A query first searches the page it lies in, which bounds its k-th distance. Blocks of queries then
visit the pages of all cells that the covering radii leave open, each query its nearest leaf first;
leaves and entries are passed over by the triangle inequality on stored distances, and the rest are
scored, a leaf with all queries of the block to which it is open in one matrix product.
Nothing is approximate: bounds are widened by a margin over the rounding of the distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, prepare, unpack, written

PAGE_ROWS = 4096
LEAF_ROWS = 256
#: Routing objects at most: a sample of this size, by hash, is broadcast and kept on the driver.
MAX_CELLS = 1024
QUERY_BLOCK = 256


def quantised(df: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(id, vec) of the rows that take part, components floor(scale * x); equal rows once."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    return df.filter(fine).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("vec")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(n), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Space:
    """The metric: distances of stored vectors, with the added coordinate, and of queries, without."""

    def __init__(self, width: int, largest: float):
        self.width, self.largest = width, largest  # the largest squared norm

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(1)))[:, None]], 1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))

    def reach(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a query has a score."""
        return np.sqrt(np.maximum(0.0, (q * q).sum(-1) + self.largest - 2 * score))

    @property
    def margin(self) -> float:
        return 1e-6 * (1.0 + np.sqrt(self.largest))


def build_page(ids: np.ndarray, x: np.ndarray, routing: np.ndarray, space: Space) -> bytes:
    """The subtree of some rows: leaves around pivots chosen farthest-first."""
    lifted = space.lifted(x)
    n_leaves = max(1, -(-len(ids) // LEAF_ROWS))
    pivot = [int(np.argmin(ids))]
    near = Space.distances(lifted, lifted[pivot])[:, 0]
    while len(pivot) < n_leaves:
        pivot.append(int(np.argmax(near)))
        near = np.minimum(near, Space.distances(lifted, lifted[pivot[-1:]])[:, 0])
    to_pivot = Space.distances(lifted, lifted[pivot])
    leaf = np.argmin(to_pivot, 1)
    order = np.argsort(leaf, kind="stable")
    first = np.searchsorted(leaf[order], np.arange(n_leaves + 1))
    own = to_pivot[np.arange(len(ids)), leaf][order]
    radius = np.array([own[a:b].max(initial=0.0) for a, b in zip(first[:-1], first[1:], strict=True)])
    parent = Space.distances(lifted[pivot], routing[None])[:, 0]
    return pack(ids[order], x[order].astype(np.float64), own, first.astype(np.int64), lifted[pivot], radius, parent)


class Page:
    def __init__(self, value: bytes, width: int):
        self.ids, x, self.own, self.first, pivots, self.radius, self.parent = unpack(value, np.int64, np.float64, np.float64, np.int64, np.float64, np.float64, np.float64)
        self.x, self.pivots = x.reshape(-1, width), pivots.reshape(-1, width + 1)

    def search(self, q: np.ndarray, own_ids: np.ndarray, floors: np.ndarray, to_routing: np.ndarray, k: int, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, id, score) of the page's rows, a query's own apart, that may be among the k best of the
        queries (rows of ``q``) given that k rows score ``floors`` or more.

        The queries go through the tree together: each first visits its nearest leaf, which tightens its bound, then
        the leaves are visited nearest first, each by the queries whose bound leaves it open."""
        floors = floors.copy()
        best = np.full((len(q), k), -np.inf)  # the k best scores so far of each query
        bound = np.where(np.isfinite(floors), space.reach(q, np.where(np.isfinite(floors), floors, 0.0)), np.inf) + space.margin
        by_parent = np.abs(to_routing[:, None] - self.parent) - self.radius
        to_pivot = Space.distances(np.concatenate([q, np.zeros((len(q), 1))], 1), self.pivots)
        lower = np.maximum(by_parent, to_pivot - self.radius)
        nearest = np.argmin(lower, 1)
        found = [(np.zeros(0, np.int64), self.ids[:0], np.zeros(0))]

        def visit(leaf: int, who: np.ndarray):
            who = who[lower[who, leaf] <= bound[who]]
            if not len(who):
                return
            a, b = self.first[leaf], self.first[leaf + 1]
            use = a + np.flatnonzero((self.own[a:b] >= (to_pivot[who, leaf] - bound[who]).min()) & (self.own[a:b] <= (to_pivot[who, leaf] + bound[who]).max()))
            ids, scores = self.ids[use], q[who] @ self.x[use].T
            scores[own_ids[who][:, None] == ids] = -np.inf
            row, at = np.nonzero((scores >= floors[who][:, None]) & (scores > -np.inf))
            found.append((who[row], ids[at], scores[row, at]))
            better = np.unique(row)
            who = who[better]
            best[who] = np.partition(np.concatenate([best[who], scores[better]], 1), -k, 1)[:, -k:]
            floors[who] = np.maximum(floors[who], best[who].min(1))
            tight = who[np.isfinite(floors[who])]
            bound[tight] = space.reach(q[tight], floors[tight]) + space.margin

        for leaf in np.unique(nearest).tolist():
            visit(leaf, np.flatnonzero(nearest == leaf))
        for leaf in np.argsort(np.median(lower, 0), kind="stable").tolist():
            visit(leaf, np.flatnonzero(nearest != leaf))
        row, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        use = np.flatnonzero(scores >= floors[row])
        use = use[np.lexsort((ids[use], -scores[use], row[use]))]
        use = use[np.arange(len(use)) - np.searchsorted(row[use], row[use]) < k]
        return row[use], ids[use], scores[use]


def top_k(df: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", every: int = 20, scale: int = 64) -> DataFrame:
    """(``query_id``, ``rank``, key, ``score``): the k rows of highest score for every row whose id is divisible by ``every``.

    Ties go to the smaller id. Vectors that are null, empty or hold nulls or non-finite numbers, and
    rows without an id, take no part; equal rows count once, a shorter vector counts as padded with
    zeros, and rows of the query's id are not its answers. Scores are exact below 2**53. Other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    result = f"query_id long, `{key}` long, score long"
    rows = written(spark, quantised(df, vector, key, scale), "quantised")
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width"), F.max(square).alias("largest")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    space = Space(sizes["width"], sizes["largest"])
    width = space.width
    n_cells = min(MAX_CELLS, -(-sizes["n"] // PAGE_ROWS))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(n_cells).select("vec").toArrow()
    routing = space.lifted(_matrix(chosen.column("vec"), width))

    def deal(batches):
        for batch in batches:
            cell = np.argmin(Space.distances(space.lifted(_matrix(batch.column("vec"), width)), routing), 1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    dealt = written(spark, rows.mapInArrow(deal, "id long, vec array<double>, cell int"), "dealt")
    pages = {r["cell"]: -(-r["n"] // PAGE_ROWS) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows at most
    n_pages = F.create_map(*(F.lit(v) for pair in pages.items() for v in pair))[F.col("cell")]
    page = F.pmod(F.xxhash64("id"), n_pages).cast("int")
    dealt = dealt.withColumn("page", page)

    def build(table):
        c = table.column("cell")[0].as_py()
        table = table.sort_by("id")
        x = _matrix(table.column("vec"), width)
        ids = table.column("id").to_numpy()
        radius = float(Space.distances(space.lifted(x), routing[c:c + 1]).max())
        return pa.table({"cell": pa.array([c], pa.int32()), "page": pa.array([table.column("page")[0].as_py()], pa.int32()), "radius": [radius], "tree": pa.array([build_page(ids, x, routing[c], space)], pa.binary())})

    tree = written(spark, dealt.groupBy("cell", "page").applyInArrow(build, "cell int, page int, radius double, tree binary"), "tree")
    radii = {r["cell"]: r["r"] for r in tree.groupBy("cell").agg(F.max("radius").alias("r")).collect()}  # MAX_CELLS rows at most
    queries = dealt.filter(F.pmod("id", F.lit(every)) == 0)
    block = "queries binary"

    def blocks_of(batches):
        """Blocks of queries by the page they lie in; nothing is known of their scores yet."""
        for batch in batches:
            x, ids, cell, at = _matrix(batch.column("vec"), width), batch.column("id").to_numpy(), batch.column("cell").to_numpy(), batch.column("page").to_numpy()
            where = cell.astype(np.int64) << 32 | at
            for w in np.unique(where).tolist():
                mine = np.flatnonzero(where == w)
                for s in range(0, len(mine), QUERY_BLOCK):
                    m = mine[s: s + QUERY_BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([w >> 32], pa.int32()), pa.array([w & 0xFFFFFFFF], pa.int32()), pa.array([pack(ids[m], x[m], np.full(len(m), -np.inf))], pa.binary())], ["cell", "page", "queries"])

    def search(batches):
        last = held = None
        for batch in batches:
            for c, q, t in zip(batch.column("cell").to_pylist(), batch.column("queries"), batch.column("tree"), strict=True):
                if (value := t.as_py()) != last:  # the blocks of a page come one after another
                    last, held = value, Page(value, width)
                ids, x, floors = unpack(q.as_py(), np.int64, np.float64, np.float64)
                x = x.reshape(-1, width)
                to_routing = Space.distances(np.concatenate([x, np.zeros((len(x), 1))], 1), routing[c:c + 1])[:, 0]
                row, found, scores = held.search(x, ids, floors, to_routing, k, space)
                yield pa.RecordBatch.from_pydict({"query_id": ids[row], key: found, "score": scores.astype(np.int64)})

    def searched(asked):
        return asked.join(tree.select("cell", "page", "tree"), ["cell", "page"]).select("cell", "queries", "tree").mapInArrow(search, result)

    home = written(spark, searched(queries.mapInArrow(blocks_of, "cell int, page int, " + block)), "home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("floor"))
    known = queries.join(floors, queries["id"] == floors["query_id"], "left").select("id", "vec", "cell", "page", F.when(F.col("found") >= k, F.col("floor").cast("double")).alias("floor"))

    def visits(batches):
        """Blocks of queries for every cell that may hold one of their k best."""
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                x, ids = _matrix(part.column("vec"), width), part.column("id").to_numpy()
                floor = np.nan_to_num(part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                bound = np.where(np.isfinite(floor), space.reach(x, np.where(np.isfinite(floor), floor, 0.0)), np.inf)
                distance = Space.distances(np.concatenate([x, np.zeros((len(x), 1))], 1), routing)
                for c, r in radii.items():
                    m = np.flatnonzero(distance[:, c] - r <= bound + space.margin)
                    if len(m):
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([pack(ids[m], x[m], floor[m])], pa.binary())], ["cell", "queries"])

    asked = known.select("id", "vec", "floor").mapInArrow(visits, "cell int, " + block).withColumn("page", F.explode(F.sequence(F.lit(0), n_pages - 1)))
    found = searched(asked).select("query_id", key, "score").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
