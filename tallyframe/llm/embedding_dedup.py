"""Embedding near-duplicates by cross-polytope hashing (operator 7).

A table's hash rotates a vector by fast Hadamard transforms with random signs and takes the largest
coordinate, with its sign: the nearest vertex of a cross-polytope. ``k`` such hashes make a bucket; a
vector is a member of its bucket in every table and visits the buckets of its likeliest other
vertices (multiprobe). Members are compared with members and visitors by cosine in double precision.
A pair that meets more than once counts where it meets first, which both vectors' codes tell, so
links are counted without listing pairs. Equal vectors are collapsed first, and buckets of more than
``BUCKET_ROWS`` rows are compared piece by piece.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import prepare, written
from .links import components
from .textcore import mix, signed

THRESHOLD = 0.93
PROBES = 1
#: Vectors a bucket holds on average, which the number of hashes a bucket is made of follows from.
BUCKET_MEAN = 1024
BUCKET_ROWS = 2048
#: How often, at least, two vectors of the threshold's cosine meet in one table of one hash and one probe (0.71 measured at 768
#: dimensions, 0.82 at 64); each further hash leaves about half of that. The tables are as many as let a pair be missed this rarely.
MEET, MISSED = 0.71, 0.03


def hashes_for(vectors: int, dim: int) -> int:
    """Hashes of a bucket: as many as spread this many vectors over buckets of ``BUCKET_MEAN``, by the 2 d values a hash of this width has."""
    values = 2 << max(1, (dim - 1).bit_length())
    return max(1, math.ceil(math.log(max(1, vectors / BUCKET_MEAN)) / math.log(values)))


def tables_for(k: int) -> int:
    return math.ceil(math.log(MISSED) / math.log(1 - MEET / 2 ** (k - 1)))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (length a power of two) after sign flips and a Hadamard transform, once per row of ``signs``."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def codes(x: np.ndarray, table: int, k: int, probes: int) -> np.ndarray:
    """(n, 1 + probes) bucket codes of one table: the own one, then the likeliest others (-1 where there are no more)."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    best, loss = [], []
    keep = min(d, 1 + probes)
    for i in range(k):
        rng = np.random.default_rng([table, i, d])
        y = rotate(wide, rng.choice([-1.0, 1.0], (3, d)))
        top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :keep]
        value = np.take_along_axis(y, top, 1)
        best.append(2 * top + (value < 0))
        loss.append(np.abs(value[:, :1]) - np.abs(value))
    own = np.zeros(n, np.int64)
    for b in best:
        own = own * (2 * d) + b[:, 0]
    out = np.full((n, 1 + probes), -1, np.int64)
    out[:, 0] = own
    if keep > 1:
        others = np.concatenate([(own[:, None] + (b[:, 1:] - b[:, :1]) * (2 * d) ** (k - 1 - i)) for i, b in enumerate(best)], 1)
        order = np.argsort(np.concatenate([x[:, 1:] for x in loss], 1), axis=1, kind="stable")[:, :probes]
        out[:, 1: 1 + order.shape[1]] = np.take_along_axis(others, order, 1)
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(rows: dict[str, np.ndarray], table: int, threshold: float, probes: int, kind: type):
    """Of one bucket piece: (vector, links counted here, smallest vector it is tied to here)."""
    member, split, low, high = rows["member"], rows["split"], rows["low"][0], rows["high"][0]
    n = len(member)
    x = units(np.stack([np.frombuffer(v, kind) for v in rows["vector"]]).astype(np.float64))
    c = np.stack([np.frombuffer(v, np.int64).reshape(-1, 1 + probes) for v in rows["codes"]])
    ours = np.flatnonzero(member)
    near = x[ours] @ x.T >= threshold
    a, b = np.nonzero(near)
    a = ours[a]
    fits = (np.minimum(split[a], split[b]) == low) & (np.maximum(split[a], split[b]) == high) & np.where(member[b], a < b, True)
    a, b = a[fits], b[fits]
    if not len(a):
        return None
    main = c[:, :, 0]
    before = np.zeros(len(a), bool)
    for t in range(table + 1):
        if t < table:
            before |= (c[a, t] == main[b, t][:, None]).any(1) | (c[b, t] == main[a, t][:, None]).any(1)
        else:
            before |= ~member[b] & (main[b, t] < main[a, t]) & (c[a, t] == main[b, t][:, None]).any(1)
    weight = rows["weight"]
    count = np.zeros(n, np.int64)
    np.add.at(count, a[~before], weight[b[~before]])
    np.add.at(count, b[~before], weight[a[~before]])
    tied = rows["id"].copy()
    while True:
        least = np.minimum(tied[a], tied[b])
        if (tied[a] == least).all() and (tied[b] == least).all():
            break
        np.minimum.at(tied, a, least)
        np.minimum.at(tied, b, least)
    some = np.unique(np.concatenate([a, b]))
    return rows["id"][some], count[some], tied[some]


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", threshold: float = THRESHOLD,
                 hashes: int | None = None, probes: int = PROBES) -> DataFrame:
    """(key, ``n_links``, ``component_id``, ``kept``) for every row of ``df``.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is
    ``threshold`` or more. Vectors that are null, empty, zero or hold nulls or non-finite numbers, and
    rows without an id, link with nothing; without an id the component and ``kept`` are null. Equal
    rows are vectors of their own. Other columns are ignored. ``hashes`` of a bucket follow from the number and the width of the
    vectors if not given, and the number of tables from them, so that the recall at the threshold stays the same.
    """
    spark = df.sparkSession
    prepare(spark)
    kind = np.float32 if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else np.float64
    df = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("vector"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = written(spark, df.filter(fine).groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    n = classes.count()

    def place(batches, whole=True):
        """Each vector in its buckets; only the buckets unless ``whole``."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("vector")
                sizes = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(sizes)])
                for d in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == d)
                    x = flat[first[rows][:, None] + np.arange(d)]
                    unit = units(x.astype(np.float64))
                    k = hashes or hashes_for(n, d)
                    tables = tables_for(k)
                    all_codes = np.stack([codes(unit, t, k, probes) for t in range(tables)], 1)
                    packed = [c.tobytes() for c in all_codes]
                    vectors = [v.tobytes() for v in x]
                    names = part.column("label").take(pa.array(rows))
                    seed = mix(np.array([hash_text(s) for s in names.to_pylist()], np.uint64) + np.uint64(d))
                    for t in range(tables):
                        for p in range(1 + probes):
                            code = all_codes[:, t, p]
                            use = np.flatnonzero(code >= 0)
                            bucket = signed(mix(seed[use] ^ mix(mix(code[use].astype(np.uint64)) + np.uint64(t))))
                            if not whole:
                                yield pa.RecordBatch.from_pydict({"bucket": bucket})
                                continue
                            yield pa.RecordBatch.from_pydict({
                                "bucket": bucket, "id": part.column("id").take(pa.array(rows[use])), "tab": pa.array(np.full(len(use), t, np.int32)), "member": pa.array(np.full(len(use), p == 0)),
                                "weight": part.column("weight").take(pa.array(rows[use])), "vector": pa.array([vectors[i] for i in use], pa.binary()), "codes": pa.array([packed[i] for i in use], pa.binary())})

    placed = classes.mapInArrow(place, "bucket long, id long, tab int, member boolean, weight long, vector binary, codes binary")
    # large buckets in pieces; the sizes are stored, so that Spark broadcasts them only if they are few
    sizes = written(spark, classes.mapInArrow(lambda batches: place(batches, whole=False), "bucket long").groupBy("bucket").agg(F.count("*").alias("rows"))
                    .filter(F.col("rows") > BUCKET_ROWS).select("bucket", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("pieces")), "large_buckets")
    split = F.pmod(F.xxhash64("id"), F.coalesce("pieces", F.lit(1))).cast("int")
    pieces = (placed.join(sizes, "bucket", "left").withColumn("split", split).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
              .withColumn("low", F.least("split", "other")).withColumn("high", F.greatest("split", "other")).drop("pieces", "other"))
    pieces = pieces.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def compare(batches):
        held: pa.Table | None = None

        def groups(table, last):
            """Finished groups of a table sorted by piece, and the rest."""
            key_columns = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
            new = np.zeros(table.num_rows, bool)
            for c in key_columns:
                new[1:] |= c[1:] != c[:-1]
            at = np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])
            stop = len(at) - 1 if last else len(at) - 2
            many = [(a, b) for a, b in zip(at[:stop].tolist(), at[1: stop + 1].tolist(), strict=True) if b - a > 1]
            out = []
            if many:
                columns = {c: table.column(c).to_numpy() for c in ("id", "member", "weight", "split", "low", "high", "tab")}
                vectors, packed = table.column("vector").to_pylist(), table.column("codes").to_pylist()
                for a, b in many:
                    if columns["member"][a:b].any():
                        rows = {c: v[a:b] for c, v in columns.items()} | {"vector": vectors[a:b], "codes": packed[a:b]}
                        found = _compare(rows, int(columns["tab"][a]), threshold, probes, kind)
                        if found:
                            out.append(found)
            return out, table.slice(int(at[stop]))

        def made(out):
            ids, count, tied = (np.concatenate([o[i] for o in out]) for i in range(3))
            return pa.RecordBatch.from_pydict({"id": ids, "n": count, "tied": tied})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= 4096:
                out, held = groups(held, False)
                if out:
                    yield made(out)
        if held is not None and held.num_rows:
            out, _ = groups(held, True)
            if out:
                yield made(out)

    found = written(spark, pieces.mapInArrow(compare, "id long, n long, tied long"), "found")
    counted = found.groupBy("id").agg(F.sum("n").alias("n"))
    tied = components(spark, found.filter(F.col("id") != F.col("tied")).selectExpr("tied as a", "id as b").distinct())
    result = written(spark, classes.join(counted, "id", "left").join(tied.withColumnRenamed("node", "id"), "id", "left")
                     .select("label", "vector", "weight", F.col("id").alias("lead"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component")), "linked")
    single = result.filter("weight = 1").select(F.col("lead").alias("id"), "n", "component")
    several = result.filter("weight > 1")
    if not several.isEmpty():
        single = single.unionByName(df.filter(fine).join(several, ["label", "vector"]).select("id", "n", "component"))
    rest = df.filter(~fine).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return single.unionByName(rest).select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def hash_text(text: str) -> int:
    raw = text.encode()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)
