"""Substring dedup, n-gram join, token counts, packing and mixing against brute force, and on odd tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import ngram_join, registry
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.ngram_join import Bands, near_groups
from tallyframe.llm.packing import first_fit_decreasing, pack_sequences
from tallyframe.llm.substring_dedup import remove_repeats
from tallyframe.llm.token_counts import count_tokens
from tests.conftest import SF_SMALL

from . import brute

SCHEMA = "doc_id long, text string, source string"
rng = random.Random(11)
VOCAB = ["w%d" % i for i in range(400)] + ["É", "naïve", "a.b", "X"]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def odd_docs():
    """Null, empty and blank texts, copies, near copies, shared passages, periodic and very long texts."""
    base, passage, line = prose(300), prose(60), prose(9)
    docs = [None, "", " \n\t ", "one", "one two three four", "ONE two three four", "for " * 70, "for " * 19, base, base, base.upper(), base + " end",
            passage, prose(40) + " " + passage + "\n" + prose(30), passage + " " + passage, prose(20_000)]
    for i in range(30):  # near copies at all distances
        w = base.split()
        for _ in range(i % 10):
            w[rng.randrange(len(w))] = f"edit{i}"
        docs.append(" ".join(w))
    docs += [line + " " + prose(rng.randint(5, 120)) for _ in range(60)]
    docs += [docs[-1] + " tail", "x" * 50_000, prose(25) + " " + prose(25)]
    return [(i * 3, t, f"s{i % 4}") for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_docs()
    # columns whose names the operators use themselves
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n_words", "block", "shard", "doc", "lead", "position", "length", "group")})
    return rows, df.repartition(3, "source")


def test_repeats_equal_brute_force(spark, docs, tmp_path):
    rows, df = docs
    df.write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r for r in remove_repeats(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    want = brute.remove_repeats([r[:2] for r in rows])
    for i, text, _ in rows:
        kept, r = want[i], got[i]
        assert (r.n_words, r.n_removed) == (len(brute.words(text)), len(brute.words(text)) - len(kept)), i
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert r.text == (" ".join(kept) if r.n_removed else text) and r.block == 1
    assert sum(r.n_removed > 0 for r in got.values()) > 20


def test_repeats_of_small_windows_and_repeated_rows(spark, tmp_path):
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.read.parquet(str(tmp_path / "d")), window=5).collect()}
    want = brute.remove_repeats(rows, 5)
    assert got == {i: len(brute.words(t)) - len(want[i]) for i, t in rows}
    twice = [(1, prose(50)), (None, None)] * 2
    spark.createDataFrame(twice, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    assert [r.n_removed for r in remove_repeats(spark.read.parquet(str(tmp_path / "t"))).collect()] == [0, 0, 0, 0]  # one document twice


def test_repeats_are_where_the_automaton_reports_them(monkeypatch):
    """Removals come from the automaton's places: of a block without any, nothing goes."""
    import numpy as np
    import pyarrow as pa

    from tallyframe.llm import substring_dedup as sd
    from tallyframe.llm.blocks import joined, pack, pack_sorted
    r = random.Random(8)
    shared = prose(30, r)
    texts = [prose(25, r) + " " + shared, None, "", shared + " " + prose(9, r) + " " + shared, prose(40, r)]
    batch = pa.record_batch({"doc_id": pa.array([5, 1, 2, 3, None], pa.int64()), "text": pa.array(texts, pa.string())})
    w = sd.Windows(batch, "text", 20)
    values, count = np.unique(w.anchors(), return_counts=True)
    got = {0: sd._recurring([joined(pack_sorted(values), np.packbits(count > 1).tobytes())])[0]}
    d = sd.Distinct(batch, w, sd._candidates(w, 1, got), "doc_id")
    got[1] = sd._first_places([joined(pack_sorted(d.h), pack(d.check, d.doc, d.start, d.twice.astype(np.uint8)))])[0]
    words, stays = sd._kept(batch, got, "text", "doc_id", 20, 1)
    gone = [int((~stays[a:b]).sum()) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    want = brute.remove_repeats(zip([5, 1, 2, 3, None], texts, strict=True))
    assert gone == [len(brute.words(t)) - len(want[i]) for i, t in zip([5, 1, 2, 3, None], texts, strict=True)] == [30, 0, 0, 30, 0]
    monkeypatch.setattr(sd, "_located", lambda w, phrases, size: np.zeros(0, np.int64))
    assert sd._kept(batch, got, "text", "doc_id", 20, 1)[1].all()


@pytest.mark.parametrize("size", [1, 2, 6])
def test_automaton_finds_every_place_in_few_steps(size, monkeypatch):
    """Phrases that are each other's suffixes and prefixes, documents around a stream's length and an empty one; the
    interpreter takes a step per word of a stream, not per hit or character."""
    import numpy as np

    from tallyframe.llm import substring_dedup as sd
    r = np.random.default_rng(size)
    lengths = [0, 1, 5, 6, sd.STREAM - 1, sd.STREAM, sd.STREAM + size, 5000, 0, 3000]
    first = np.concatenate([[0], np.cumsum(lengths)])
    h = r.choice(np.array([7, 1 << 63, 12345678901, 3], np.uint64), int(first[-1]))
    h[r.random(len(h)) < 0.1] = 99  # a word that may be in no phrase
    at = r.choice(np.concatenate([np.arange(a, max(a, b - size + 1)) for a, b in zip(first[:-1], first[1:], strict=True)]), 40)
    phrases = {tuple(h[a: a + size].tolist()) for a in at.tolist()}
    want = [a for d, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) for a in range(d, e - size + 1) if tuple(h[a: a + size].tolist()) in phrases]
    machine, steps, step = sd.Automaton(h[at[:, None] + np.arange(size)]), [], sd.Automaton.step
    monkeypatch.setattr(sd.Automaton, "step", lambda self, *a: steps.append(1) or step(self, *a))
    assert sorted(machine.places(h, first).tolist()) == want
    assert len(steps) == sd.STREAM + size - 1


def test_near_groups_equal_brute_force(docs):
    rows, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df).collect()}
    assert got == brute.near_groups([r[:2] for r in rows])


def test_near_groups_at_the_threshold(spark):
    """Pairs of every small size just inside and outside of the threshold; repeated rows and null ids."""
    r, rows = random.Random(2), []
    for n in [*range(5, 60), 90, 130, 200, 400]:
        w = [f"t{n}_{i}" for i in range(n)]
        for edits in range(0, max(2, n // 12)):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(n)] = f"e{r.random()}"
            rows.append((len(rows), " ".join(v)))
            rows.append((len(rows), " ".join(v[r.randrange(3):])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_groups(spark.createDataFrame(rows + [(None, "a b"), (None, "a b")] + rows[:3], "doc_id long, text string")).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute.near_groups(rows)


def test_bands_hold_every_link():
    bands = Bands()
    sizes = np.arange(1, 3000)
    band, partner = bands.of(sizes), bands.of(sizes * 100 // 80)
    assert ((partner == band) | (partner == band + 1)).all()
    for n in range(1, 400):
        m, d = bands.spread(int(bands.of(np.array([n]))[0]))
        assert m > d >= (n + n * 100 // 80) // 9


def test_token_counts_and_packing_equal_the_library(docs):
    rows, df = docs
    special = [(5000, "a<|endoftext|> b", "s0"), (5001, "it's  we'll\r\n\n 12²3 　字", "s0")]
    df = df.select("doc_id", "text", "source", "length").unionByName(df.sparkSession.createDataFrame(special, SCHEMA).withColumn("length", F.lit(1)))
    rows = rows + special
    library = Tokenizer.from_file(registry.BYTE_BPE)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(df, registry.BYTE_BPE).collect()}
    assert counted == {i: (len((t or "").encode()), len(ids[i])) for i, t, _ in rows}
    pieces = pack_sequences(df, registry.BYTE_BPE, group_rows=16).collect()
    check_pieces(pieces, {i: [x] for i, x in ids.items()})


def check_pieces(pieces, ids):
    """Every id of every copy lies in one piece; sequences are gapless and little of them is padding. ids: by document a list of copies."""
    bins, starts = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for p in pieces:
        want = np.array(ids[p.doc_id][0] + [1], "<u4")
        assert p.ids_crc32 == zlib.crc32(want[p.start: p.start + p.length].tobytes()) and p.doc_tokens == len(want)
        bins[p.sequence_id].append((p.offset, p.length))
        starts[p.doc_id][(p.start, p.length)] += 1
    for i, copies in ids.items():
        n = len(copies[0]) + 1
        assert starts[i] == {(s, min(2048, n - s)): len(copies) for s in range(0, n, 2048)} or not copies
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


def test_first_fit_decreasing_equals_a_scan():
    lengths = np.array([rng.randint(1, 100) for _ in range(300)])
    where, offset = first_fit_decreasing(lengths, 100)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (where[i], offset[i]) == (b, 100 - free[b])
        free[b] -= lengths[i]


def test_mixing_draws_what_the_rates_say(spark, docs):
    rows, df = docs
    got = collections.Counter(r.doc_id for r in mix_sources(df).collect())
    assert got == collections.Counter({i: n for i, n in brute.mixed([(i, s, t) for i, t, s in rows]).items() if n})
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, None).otherwise("b").alias("source"))
    copies = mix_sources(many, weights={"a": 3.0, "": 1.0, "absent": 1.0}, total=160_000).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in copies}
    assert set(share) == {"a", None}
    assert abs(share["a"] - 12_000) < 600 and abs(share[None] - 4_000) < 350  # shares of the sources that there are
    order = [r.position for r in mix_sources(many).coalesce(1).collect()]
    assert len(set(order)) == len(order)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for run in (remove_repeats, near_groups, mix_sources, lambda d: count_tokens(d, registry.BYTE_BPE), lambda d: pack_sequences(d, registry.BYTE_BPE)):
        assert run(empty).count() == 0


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op10_ngram_jaccard_join"])
def test_queries_over_the_whole_table(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES[name](spark, SF_SMALL).collect()
    if name.startswith("op2"):
        want = brute.remove_repeats(rows)
        assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(" ".join(w).encode()).hexdigest() for i, w in want.items()}
    else:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(rows)


def test_near_groups_of_an_id_with_two_texts(spark, monkeypatch):
    """An id has the links of all its texts, also where only the comparison within families finds them."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 3)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for g in range(6):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            docs.append((len(docs), " ".join(w)))
    two = docs + [(5, docs[40][1] + " tail"), (5, docs[70][1])]
    got = {r.doc_id: r.component_id for r in ngram_join.near_groups(spark.createDataFrame(two, "doc_id long, text string")).collect()}
    sets = [(i, brute.shingles(t)) for i, t in two]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if 100 * len(x & y) >= 80 * len(x | y)]
    assert got == brute.components({i for i, _ in two}, links)
