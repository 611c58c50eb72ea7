"""N-gram Jaccard join by parity sketches (operator 10).

Two documents link when the Jaccard similarity of their shingle sets is ``THRESHOLD`` or more.

* Sizes fall into bands such that sets of one link lie in one band or in neighbouring ones. A set is
  sketched under its own band and, for partners of smaller size, under the band below.
* A sketch under a band has m words; each shingle is XORed into the word its hash chooses, so a
  shingle of the symmetric difference changes one word at most, and the number of differing words
  is a lower bound of the symmetric difference, which is d or less for a link in that band. A set that
  fills more than d words therefore agrees with each partner in one of them (pigeonhole).
* If more than d words hold two shingles or more, only those are joined on: single shingles of
  passages that many documents share make no candidates then. Otherwise all filled words are, and a
  set that fills d words or fewer is sketched again with the next salt, until it fills more. Of two
  linked sets one has the fewest salts; under its last one both are present, so no link is lost.
* Sketch words are dealt out by bands and, within a band, by hash ranges; the sets that share a word are paired with the one of
  smallest id. A pair is dropped if the Hamming distance of two short parity sketches of one bit per
  shingle, again a lower bound, is over d, and is verified on the texts otherwise.
* The family of a set are all that share a word with it of which it has the smallest id; any two that share a word are in
  one family. The sets of a family that end up in different components are then compared with each other, sketch by sketch in
  blocks: first each with its nearest one of each other component, and when what proves to be a link is merged, all that is left.
  So the components are those of all links, and large components that many pairs link take a pair a set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUESTION_SCHEMA, cut, joined, pack, pack_sorted, parted, prepare, question_batch, shards_for, split_sorted, text_bytes, unpack, unpack_sorted, written
from .links import components
from .textcore import LOWER, Words, chunks, mix, range_hashes, signed, text_buffer, tidy, window_hashes

SHINGLE = 5
THRESHOLD = (80, 100)  # intersection * 100 >= union * 80
#: Bits of a parity sketch per difference that a link may have: the more, the closer its distance comes to the true one.
SKETCH_BITS = 8
#: Rows of one group that a task compares with as many others.
GROUP_ROWS = 4096


class Bands:
    """Size bands and, for each, the number of sketch words and the largest symmetric difference of a link."""

    def __init__(self, threshold: tuple[int, int] = THRESHOLD):
        self.num, self.den = threshold
        edges = [1]
        while edges[-1] < 1 << 40:
            e = edges[-1]
            edges.append(max(e + 1, self.largest(e - 1) + 1))
        self.edges = np.array(edges)

    def largest(self, size: int) -> int:
        """The largest partner of a set of this size or less."""
        return size * self.den // self.num

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def spread(self, band: int) -> tuple[int, int]:
        """(words m, largest symmetric difference d) of a band of the smaller set."""
        top = int(self.edges[band + 1]) - 1
        d = (top + self.largest(top)) * (self.den - self.num) // (self.den + self.num)
        return d + 1 + 2 * (d + 1) // 5 if d else 1, d


def shingle_sets(batch: pa.RecordBatch, text: str, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the documents one after another, and where each document's begin (n + 1).

    A text of fewer than k words has its whole word sequence as its only shingle; one of no words none."""
    buf, off = text_buffer(batch.column(text))
    w = Words(LOWER[buf], off)
    h = w.hashes()
    count = np.diff(w.first)
    all_k = window_hashes(h, k)
    short = np.flatnonzero((count > 0) & (count < k))
    whole = range_hashes(h, w.first[short], w.first[short + 1])
    row = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.repeat(w.first[1:], count) - np.arange(len(h)) >= k)
    values = np.concatenate([all_k[at], whole])
    rows = np.concatenate([row[at], short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(count) + 1))


def digests(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    out = []
    for salt in (0x1F83D9AB, 0x5BE0CD19):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]]))
    return out[0], out[1]


def _block_sets(batch: pa.RecordBatch, text: str, key: str):
    """Ids, shingle sets, digests, and for each row the first row of the block with the same set."""
    values, first = shingle_sets(batch, text)
    one, two = digests(values, first)
    ids = batch.column(key).to_numpy(zero_copy_only=False)
    _, lead, own = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_inverse=True) if len(ids) else (0, np.zeros(0, int), np.zeros(0, int))
    return ids, values, first, one, two, lead[own.ravel()] if len(ids) else lead


def sketch_words(values: np.ndarray, first: np.ndarray, rows: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the non-empty sketch words of the chosen rows' sets, and the row and the band of each."""
    size = np.diff(first)[rows]
    band = bands.of(size)
    below = np.array([b > 0 and s <= bands.largest(int(bands.edges[b]) - 1) for s, b in zip(size.tolist(), band.tolist(), strict=True)], bool)
    rows, band = np.concatenate([rows, rows[below]]), np.concatenate([band, band[below] - 1])
    keys, owners, under, salt = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    spread = {int(b): bands.spread(int(b)) for b in np.unique(band)}
    while len(rows):
        m, d = (np.array([spread[b][i] for b in band.tolist()]) for i in (0, 1))
        n = first[rows + 1] - first[rows]
        item = np.repeat(np.arange(len(rows)), n)
        v = values[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        v = mix(v + np.uint64(0x9E37 + 2 * salt + 1))
        word = (v % m[item].astype(np.uint64)).astype(np.int64)
        slot = np.repeat(np.cumsum(m) - m, n) + word
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        at = np.flatnonzero(np.diff(slot, prepend=-1))
        parity = np.bitwise_xor.reduceat(mix(v[order] + np.uint64(7)), at) if len(at) else np.zeros(0, np.uint64)
        mine = item[order[at]]
        filled, twice = np.bincount(mine, minlength=len(rows)), np.diff(np.append(at, len(slot))) > 1
        enough = np.bincount(mine, twice, len(rows)) > d
        use = twice | ~enough[mine]
        place = (band[mine].astype(np.uint64) << np.uint64(48)) + (np.uint64(salt) << np.uint64(40)) + word[order[at]].astype(np.uint64)
        keys.append(mix(parity ^ mix(place))[use])
        owners.append(rows[mine[use]])
        under.append(band[mine[use]])
        again = filled <= d
        rows, band, salt = rows[again], band[again], salt + 1
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(under)


def key_ranges(volume: dict[int, int], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Where each band's keys begin in the space of 64-bit keys, and a 2**32nd of the room they have there, by volume of words.

    So the words of one band lie in as few shards as their volume allows, and a pair that shares many words is found in few of them."""
    n = len(bands.edges)
    share = np.array([volume.get(b, 0) for b in range(n)], float)
    share = (share + share.sum() * 1e-9 + 1e-9) / (share + share.sum() * 1e-9 + 1e-9).sum()
    room = np.floor(share * ((1 << 32) - 1)).astype(np.uint64)
    return (np.cumsum(room) - room) << np.uint64(32), room


def placed_keys(keys: np.ndarray, band: np.ndarray, ranges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys moved into the ranges of their bands."""
    start, room = ranges[0][band], ranges[1][band]
    high, low = keys >> np.uint64(32), keys & np.uint64((1 << 32) - 1)
    return start + high * room + (low * room >> np.uint64(32))


def parity_sketches(values: np.ndarray, first: np.ndarray, band: np.ndarray, bands: Bands) -> list[bytes]:
    """A parity bit sketch of every set under the given bands (below 0: none), of ``SKETCH_BITS`` bits per allowed difference."""
    d = {int(b): bands.spread(int(b))[1] for b in np.unique(band) if b >= 0}
    size = np.array([64 * (-(-SKETCH_BITS * (d[b] + 1) // 64)) if b >= 0 else 0 for b in band.tolist()], np.int64)
    n = np.where(size > 0, np.diff(first), 0)
    item = np.repeat(np.arange(len(n)), n)
    v = values[np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    slot = (mix(v ^ np.uint64(0x5DEECE66D)) % size[item].astype(np.uint64)).astype(np.int64) + (np.cumsum(size) - size)[item]
    raw = np.packbits((np.bincount(slot, minlength=int(size.sum())) & 1).astype(np.uint8)).tobytes()
    end = np.cumsum(size) // 8
    return [raw[a:b] for a, b in zip((end - size // 8).tolist(), end.tolist(), strict=True)]


def most_apart(bands: Bands, n_a, n_b):
    """The largest symmetric difference of a link between sets of these sizes (numbers or arrays)."""
    return (n_a + n_b) * (bands.den - bands.num) // (bands.den + bands.num)


def may_link(bands: Bands, n_a: np.ndarray, own_a: list, low_a: list, n_b: np.ndarray, own_b: list, low_b: list) -> np.ndarray:
    """Whether sizes and sketches leave a link possible, pair by pair."""
    band_a, band_b = bands.of(np.maximum(n_a, 1)), bands.of(np.maximum(n_b, 1))
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = (small > 0) & (large <= bands.largest(small))
    at = np.flatnonzero(out)
    # the sketch of each under the band of the smaller set
    x = [low_a[i] if band_a[i] > band_b[i] else own_a[i] for i in at.tolist()]
    y = [low_b[i] if band_b[i] > band_a[i] else own_b[i] for i in at.tolist()]
    size = np.array([len(v) for v in x], np.int64)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        bits = [np.frombuffer(b"".join(v[i] for i in rows.tolist()), np.uint64).reshape(len(rows), -1) for v in (x, y)]
        pair = at[rows]
        out[pair] = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64) <= most_apart(bands, n_a[pair], n_b[pair])
    return out


def _ask(df: DataFrame, text: str, key: str, bands: Bands, ranges: tuple[np.ndarray, np.ndarray], n_shards: int) -> DataFrame:
    def run(batches):
        for block, batch in cut(batches, text):
            ids, values, first, _, _, lead = _block_sets(batch, text, key)
            rows = np.flatnonzero((lead == np.arange(len(ids))) & (np.diff(first) > 0))
            keys, owners, under = sketch_words(values, first, rows, bands)
            keys = placed_keys(keys, under, ranges)
            order = np.argsort(keys)
            keys, owners = keys[order], ids[owners[order]]
            yield question_batch([(s, block, joined(pack_sorted(keys[p]), pack(owners[p]))) for s, p in split_sorted(keys, n_shards)])

    return df.mapInArrow(run, QUESTION_SCHEMA)


def _sharers(questions: DataFrame) -> DataFrame:
    """(a, b): ids that share a sketch word with ``a``, the smallest id of that word; a pair once a shard."""

    def run(table: pa.Table) -> pa.Table:
        parts = [(unpack_sorted(a), unpack(b, np.int64)[0]) for a, b in (parted(q.as_py()) for q in table.column("question"))]
        keys, docs = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs = keys[new], docs[new]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(at, len(keys)))
        many = np.repeat(n > 1, n)
        lead, docs = np.repeat(docs[at], n)[many], docs[many]
        pairs = np.unique(np.stack([lead, docs], 1)[lead != docs], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return questions.groupBy("shard").applyInArrow(run, "a long, b long")


SKETCHED = ("n", "one", "two", "own", "low")


def _verified(spark: SparkSession, df: DataFrame, sets: DataFrame, pairs: DataFrame, text: str, key: str, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: by digest if equal, else by their sketches and then their texts."""
    num, den = bands.num, bands.den
    both_sets = pairs.join(sets.select(F.col("doc").alias("a"), *(F.col(c).alias(f"{c}_a") for c in SKETCHED)), "a") \
        .join(sets.select(F.col("doc").alias("b"), *(F.col(c).alias(f"{c}_b") for c in SKETCHED)), "b")

    def sift(batches):
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            equal = (c["n_a"] == c["n_b"]) & (c["one_a"] == c["one_b"]) & (c["two_a"] == c["two_b"])
            keep = equal | may_link(bands, c["n_a"], c["own_a"], c["low_a"], c["n_b"], c["own_b"], c["low_b"])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal)], ["a", "b", "equal"]).filter(pa.array(keep))

    pairs = written(spark, both_sets.mapInArrow(sift, "a long, b long, equal boolean"), "pairs")
    open_pairs = pairs.filter(~F.col("equal")).select("a", "b").distinct()
    wanted = written(spark, open_pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    texts = written(spark, df.select(F.col(key).alias("doc"), F.col(text).alias("body")).join(wanted, "doc", "left_semi"), "texts")
    both = (open_pairs.join(texts.selectExpr("doc as a", "body as text_a"), "a")
            .join(texts.selectExpr("doc as b", "body as text_b"), "b").select("a", "b", "text_a", "text_b"))

    def check(batches):
        for batch in batches:
            for part in chunks(batch, "text_a"):
                (va, fa), (vb, fb) = (shingle_sets(part, c) for c in ("text_a", "text_b"))
                linked = []
                for i in range(part.num_rows):
                    x, y = va[fa[i]: fa[i + 1]], vb[fb[i]: fb[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(common > 0 and common * den >= (len(x) + len(y) - common) * num)
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
        tidy()

    return written(spark, pairs.filter("equal").select("a", "b").unionByName(both.mapInArrow(check, "a long, b long")), "verified")


def _across(spark: SparkSession, left: DataFrame, sets: DataFrame, bands: Bands, nearest: bool) -> DataFrame:
    """Pairs (a, b) of one family and different components that sketches leave possible; large families in blocks by blocks.

    With ``nearest``, only the nearest partner of each set in each other component of a block."""
    pieces = written(spark, left.groupBy("family").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("pieces")).filter("pieces > 1"), "large_families")
    n = F.coalesce("pieces", F.lit(1))
    rows = (left.join(pieces, "family", "left").withColumn("piece", F.pmod(F.xxhash64("doc"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("family", "doc", "component", "least_band", "piece", F.least("piece", "other").alias("low_piece"), F.greatest("piece", "other").alias("high_piece")))
    rows = rows.join(sets.select("doc", "n", "band", "own", "low"), "doc")
    # the sketch under the band below is for smaller sets of the family, if there are any
    rows = rows.withColumn("low", F.when(F.col("band") > F.col("least_band"), F.col("low"))).drop("least_band", "band")

    def compare(table: pa.Table) -> pa.Table:
        doc, component, size, piece = (table.column(c).to_numpy() for c in ("doc", "component", "n", "piece"))
        crossed = table.column("low_piece")[0].as_py() != table.column("high_piece")[0].as_py()
        own, low = table.column("own").to_pylist(), table.column("low").to_pylist()
        band = bands.of(size)
        found = [np.zeros((0, 3), np.int64)]
        for b in np.unique(band).tolist():
            ours, above = np.flatnonzero(band == b), np.flatnonzero(band == b + 1)
            all_rows = np.concatenate([ours, above])
            bits = np.stack([np.frombuffer(own[i], np.uint64) for i in ours.tolist()] + [np.frombuffer(low[i], np.uint64) for i in above.tolist()])
            step = max(1, (1 << 18) // (bits.size or 1))
            for at in range(0, len(ours), step):
                i, rest = ours[at: at + step, None], all_rows[None, at:]
                near = (component[rest] != component[i]) & (np.maximum(size[rest], size[i]) * bands.num <= np.minimum(size[rest], size[i]) * bands.den)
                near &= np.arange(rest.shape[1])[None] > np.arange(len(i))[:, None]
                if crossed:
                    near &= piece[rest] != piece[i]
                if near.any():
                    apart = np.bitwise_count(bits[at: at + len(i), None] ^ bits[None, at:]).sum(2, dtype=np.int64)
                    x, y = np.nonzero(near & (apart <= most_apart(bands, size[rest], size[i])))
                    found.append(np.stack([i[x, 0], rest[0, y], apart[x, y]], 1))
                    if nearest:
                        found[-1] = _nearest(found[-1], component)
        pairs = np.concatenate(found)
        if nearest:
            pairs = _nearest(pairs, component)
        pairs = np.unique(np.sort(doc[pairs[:, :2]], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("family", "low_piece", "high_piece").applyInArrow(compare, "a long, b long").distinct()


def _nearest(pairs: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Of rows (i, j, distance) those that are the nearest of i in j's component or of j in i's."""
    keep = np.zeros(len(pairs), bool)
    for one, other in ((0, 1), (1, 0)):
        order = np.lexsort((pairs[:, other], pairs[:, 2], component[pairs[:, other]], pairs[:, one]))
        key = np.stack([pairs[order, one], component[pairs[order, other]]], 1)
        first = np.ones(len(order), bool)
        first[1:] = (key[1:] != key[:-1]).any(1)
        keep[order[first]] = True
    return pairs[keep]


def _apart(spark: SparkSession, families: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """(family, doc, component, least_band) of the families that lie in several components."""
    where = docs.join(found.selectExpr("node as doc", "component"), "doc", "left").select("doc", "band", F.coalesce("component", "doc").alias("component"))
    placed = written(spark, families.join(written(spark, where, "where"), "doc"), "placed")
    split = (placed.groupBy("family").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("band").alias("least_band"))
             .filter("low < high").select("family", "least_band"))
    return written(spark, placed.join(written(spark, split, "split"), "family").drop("band"), "left")


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(key, ``n_shingles``, ``component_id``) for every row of ``df``.

    Null and empty texts have no shingles and link with nothing; a row without an id links with
    nothing and has a null component; rows of one id are one document, and an id has the links of
    all its texts. Other columns are ignored. The input is read several times and has to come in the same order
    each time, as a scan does.
    """
    spark = df.sparkSession
    prepare(spark)
    bands = Bands(threshold)
    df = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    known = df.filter(F.col(key).isNotNull())
    n_shards = shards_for(text_bytes(df, text))

    def measure(batches):
        for _, batch in cut(batches, text):
            ids, values, first, one, two, lead = _block_sets(batch, text, key)
            n = np.diff(first)
            band = np.where(n > 0, bands.of(np.maximum(n, 1)), -1)
            own, low = (parity_sketches(values, first, x, bands) for x in (band, band - 1))
            yield pa.RecordBatch.from_pydict({"doc": batch.column(key), "n": n, "one": signed(one), "two": signed(two), "band": band.astype(np.int32), "own": pa.array(own, pa.binary()), "low": pa.array(low, pa.binary()),
                                              "lead": pa.array(ids[lead], pa.int64())})

    sets = written(spark, known.mapInArrow(measure, "doc long, n long, one long, two long, band int, own binary, low binary, lead long"), "sets")
    volume = {r["band"]: r["n"] * bands.spread(r["band"])[0] for r in sets.filter("doc = lead and n > 0").groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a band
    ranges = key_ranges({b: volume.get(b, 0) + volume.get(b + 1, 0) for b in range(-1, max(volume, default=0) + 1)}, bands)
    tested = written(spark, _sharers(_ask(known, text, key, bands, ranges, n_shards)).distinct(), "candidates")
    copies = sets.filter((F.col("doc") != F.col("lead")) & (F.col("n") > 0)).selectExpr("lead as a", "doc as b")
    links = copies.unionByName(_verified(spark, known, sets, tested, text, key, bands))
    found = components(spark, links)
    # what is of one family but in different components, and has not been compared
    families = tested.selectExpr("a as family", "b as doc").unionByName(tested.selectExpr("a as family", "a as doc").distinct())
    texts_of = written(spark, sets.dropDuplicates(["doc", "one", "two"]), "texts_of")
    docs = sets.groupBy("doc").agg(F.min("band").alias("band"))
    for nearest in (True, False):
        left = _apart(spark, families, docs, found)
        if left.isEmpty():
            break
        more = written(spark, _across(spark, left, texts_of, bands, nearest).join(tested, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            tested = tested.unionByName(more)
            links = links.unionByName(_verified(spark, known, sets, more, text, key, bands))
            found = components(spark, links)
    counted = sets.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"))
    if df.filter(F.col(key).isNull()).isEmpty():
        lost = None
    else:
        lost = df.filter(F.col(key).isNull()).mapInArrow(lambda it: (pa.RecordBatch.from_pydict({key: b.column(key), "n_shingles": np.diff(shingle_sets(b, text)[1])}) for b in it), counted.schema)
    out = counted.join(found.withColumnRenamed("node", key), key, "left").select(key, "n_shingles", F.coalesce("component", key).alias("component_id"))
    return out if lost is None else out.unionByName(lost.withColumn("component_id", F.lit(None).cast("long")))
