"""Top-k, license scan, toxicity, chat formatting and embedding dedup against brute force, and on odd tables."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import registry, toxicity
from tallyframe.llm.chat import chat_digest, format_chats, read_back
from tallyframe.llm.embedding_dedup import near_vectors
from tallyframe.llm.licenses import TEMPLATES, scan_licenses
from tallyframe.llm.mtree import top_k
from tests.conftest import SF_SMALL

from .brute import components

rng = np.random.default_rng(3)
VECTORS = "vec_id long, embedding array<float>, label int, vector int, id int, cell int"


def odd_vectors():
    """Clusters, copies, nulls, zeros, non-finite numbers, short vectors, null ids and labels."""
    rows = []
    for _ in range(12):
        c = rng.normal(size=16)
        rows += [(c + rng.normal(size=16) * s).tolist() for s in rng.choice([0.0, 0.05, 0.1, 0.3], 8)]
    rows += [rng.normal(size=16).tolist() for _ in range(60)]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0, None] + [1.0] * 14, [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]
    out = [(i * 5, v, None if i % 41 == 0 else i % 2, 1, 1, 1) for i, v in enumerate(rows)]
    return out + [(None, rows[0], 1, 1, 1, 1)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS)
    vectors = {r.vec_id: [math.floor(64 * x) for x in r.embedding] for r in df.collect() if r.vec_id is not None and usable(r.embedding)}
    want = {}
    for q in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], vectors[o])), o) for o in vectors if o != q)
            want[q] = [(n + 1, o, -s) for n, (s, o) in enumerate(scored[:7])]
    got = {}
    for r in top_k(df.unionByName(df.limit(3)), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == want


@pytest.mark.parametrize("known", [False, True])
def test_page_search_scores_blocks_of_queries_leaf_by_leaf(known, monkeypatch):
    """A page gives each query of a block its k best, ties by id, in work by leaf and not by query and leaf; a bound that
    is known shuts leaves and entries, and loses nothing."""
    from tallyframe.llm import mtree
    r = np.random.default_rng(5)
    centres = r.integers(-60, 60, (12, 16))
    x = (centres[r.integers(0, 12, 900)] + r.integers(-4, 5, (900, 16))).astype(np.float64)
    x[100:150] = x[7]  # ties
    ids = np.arange(900, dtype=np.int64) * 3
    space = mtree.Space(16, float((x * x).sum(1).max()))
    monkeypatch.setattr(mtree, "LEAF_ROWS", 16)
    page = mtree.Page(mtree.build_page(ids, x, space.lifted(x[:1])[0], space), 16)
    mine = np.concatenate([r.choice(900, 199, replace=False), [7]])
    q = np.concatenate([x[mine], r.integers(-60, 60, (40, 16)).astype(np.float64)])
    own = np.concatenate([ids[mine], np.full(40, -1)])
    scores = np.where(own[:, None] == ids, -np.inf, q @ x.T)
    want = [[(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:5]] for s in scores]
    floors = np.array([w[-1][1] for w in want]) if known else np.full(len(q), -np.inf)
    calls, reach = [], mtree.Space.reach
    monkeypatch.setattr(mtree.Space, "reach", lambda self, *a: calls.append(1) or reach(self, *a))
    to_routing = mtree.Space.distances(np.concatenate([q, np.zeros((len(q), 1))], 1), space.lifted(x[:1]))[:, 0]
    row, found, score = page.search(q, own, floors, to_routing, 5, space)
    got = [[] for _ in q]
    for i, j, s in zip(row.tolist(), found.tolist(), score.tolist(), strict=True):
        got[i].append((j, s))
    assert got == want
    assert len(calls) <= 1 + 2 * len(page.radius)


def test_top_k_small_pages_and_few_rows(spark, monkeypatch):
    from tallyframe.llm import mtree
    monkeypatch.setattr(mtree, "PAGE_ROWS", 64)
    monkeypatch.setattr(mtree, "LEAF_ROWS", 8)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:340] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for r_id, group in ((i, np.lexsort((np.arange(600), -(q @ q[i])))) for i in (0, 300, 580)):
        want = [(int(j), int(q[j] @ q[r_id])) for j in group if j != r_id][:20]
        got = [(r.vec_id, r.score) for r in top_k(df).filter(F.col("query_id") == r_id).orderBy("rank").collect()]
        assert got == want
    few = top_k(df.filter("vec_id < 3")).collect()
    assert [(r.rank, r.query_id) for r in sorted(few, key=lambda r: r.rank)] == [(1, 0), (2, 0)]
    assert top_k(df.limit(0)).count() == 0


def brute_links(rows):
    keep = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and usable(v) and any(v):
            x = np.asarray(v, np.float32).astype(np.float64)
            keep[i] = (label, x / np.linalg.norm(x))
    ids = sorted(keep)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if keep[a][0] == keep[b][0] and len(keep[a][1]) == len(keep[b][1]) and keep[a][1] @ keep[b][1] >= 0.93]
    found = components([r[0] for r in rows if r[0] is not None], links)
    return {i: (sum(i in x for x in links), found[i], found[i] == i) for i in found}


def test_near_vectors_equal_brute_force(spark):
    rows = odd_vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got.pop(None) == (0, None, None)
    want = brute_links(rows)
    assert got.keys() == want.keys()
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.9 * there and all(got[i][0] <= want[i][0] for i in want)  # recall, and no link below the threshold
    assert there > 50


def test_near_vectors_in_pieces_of_large_buckets(spark, monkeypatch):
    from tallyframe.llm import embedding_dedup
    monkeypatch.setattr(embedding_dedup, "BUCKET_ROWS", 16)
    c = rng.normal(size=16)
    rows = [(i, (c + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), 1, 1, 1, 1) for i in range(80)] + [(100 + i, c.tolist(), 1, 1, 1, 1) for i in range(40)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == {i: 119 for i, *_ in rows}
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("dim, hashes", [(64, 2), (64, 3), (64, 4), (768, 2), (768, 3), (768, 4)])
def test_recall_and_counts_of_several_hashes(spark, dim, hashes):
    """Pairs just over the threshold, in buckets of many hashes: the recall stays, and who shares a component has links."""
    r = np.random.default_rng([dim, hashes])
    x = r.normal(size=(150, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.935 * x + math.sqrt(1 - 0.935 ** 2) * z
    rows = [(2 * i + j, v.tolist(), 1) for i in range(len(x)) for j, v in enumerate((x[i], y[i]))]
    got = {v.vec_id: v for v in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), hashes=hashes).collect()}
    linked = [i for i in range(len(x)) if got[2 * i + 1].component_id == 2 * i]
    assert len(linked) >= 0.9 * len(x)
    assert {i for i, v in got.items() if v.n_links == 1} == {2 * i + j for i in linked for j in (0, 1)} and all(v.n_links <= 1 for v in got.values())


def test_recall_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/../sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sum(r.n_links for r in registry.op7_embedding_near_dedup(spark, f"{SF_SMALL}/../sf0.1").collect())
    there = 0
    for label in {r[2] for r in rows}:
        x = np.array([r[1] for r in rows if r[2] == label], np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        there += int((x @ x.T >= 0.93).sum()) - len(x)
    assert 0.9 * there <= got <= there


def test_licenses_on_odd_texts(spark):
    texts = [None, "", "CC BY cc-by", "General  Public\nLicense. ALL RIGHTS RESERVED", "cc bye", "Licensed under the Apache License, Version 2.0.",
             "all rights, all rights reserved " * 3, "Kby ccé by", "x " * 30_000 + "cc by", "Permission is hereby granted"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "words", "label", "start")})
    got = {r.doc_id: r for r in scan_licenses(df.unionByName(df.filter("doc_id = 2"))).collect()}
    base = {i: (r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()}
    assert base == {0: (0, None, None, ""), 1: (0, None, None, ""), 2: (2, 0, 2, "cc-by"), 3: (2, 0, 3, "gpl,reserved"), 4: (0, None, None, ""), 5: (0, None, None, ""),
                    6: (3, 2, 12, "reserved"), 7: (0, None, None, ""), 8: (1, 30_000, 30_000, "cc-by"), 9: (0, None, None, "")}
    assert got[5].labels == "apache-2" and got[9].labels == "mit" and got[5].score == 1.0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == 0 and got[7].n_words == 3 and got[5].words == 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_licenses_of_texts_that_begin_with_the_phrase(spark):
    texts = [t.phrase + tail for t in TEMPLATES for tail in (" and more", "")] + ["more " + t.phrase for t in TEMPLATES]
    titles = {"MIT License": "mit", "Apache License Version 2.0, January 2004": "apache-2", "Mozilla Public License Version 2.0": "mpl", "CC BY-NC 4.0": "cc-by,cc-by-nc"}
    filler = ["nothing here"] * 5  # so that no word is in all documents
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts + list(titles) + filler)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in found}
    for i, text in enumerate(texts):
        label = (TEMPLATES[i // 2] if i < 2 * len(TEMPLATES) else TEMPLATES[i - 2 * len(TEMPLATES)]).label
        assert label in got[i].labels.split(",") and got[i].score > 0, text
        assert got[i].first_word is None or got[i].first_word >= 0
    assert [got[len(texts) + k].labels for k in range(len(titles))] == list(titles.values())
    assert [got[len(texts) + len(titles) + k].score for k in range(5)] == [0] * 5
    at = next(i for i, t in enumerate(TEMPLATES) if t.label == "mpl")
    assert {p.start for p in got[2 * at].places if p.verified} == {-6}


def test_license_scan_is_native(spark):
    plan = registry.op4_license_scan(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_disguised_words_are_restored(spark):
    docs = spark.createDataFrame([(i, "the stupid idiot and the worthless loser said so, they are pathetic " * 3) for i in range(20)], "doc_id long, text string")
    cost = toxicity._language_costs(docs, "text")
    for seen, meant in ((b"1d10t", b"idiot"), (b"i d i o t", b"idiot"), (b"l0s3r", b"loser"), (b"l.o.s.e.r", b"loser"), (b"stuuupid", b"stupid"), (b"p4thet1c!!", b"pathetic"), (b"$tup1d", b"stupid")):
        assert toxicity.restored(seen, cost) == meant


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(4)
    plain = ["tree", "house", "river", "stone", "cloud", "bread", "light", "water"]
    bad = ["idiot", "loser", "moron", "stupid"]

    def text(toxic, disguise=False):
        w = [r.choice(plain) for _ in range(40)]
        for _ in range(4 * toxic):
            b = r.choice(bad)
            w[r.randrange(40)] = b.replace("i", "1").replace("o", "0") if disguise else b
        return " ".join(w)

    docs = [(i, text(i % 4 == 0, i % 8 == 0)) for i in range(600)] + [(1000, None), (1001, ""), (None, text(True))]
    labels = [(i, int(i % 4 == 0)) for i in range(600)] + [(7, None), (None, 1), (3, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1), "h": F.lit(1)})
    tags = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score_toxicity(df, tags).collect()}
    right = [out[i].predicted == (i % 4 == 0) for i in range(600) if out[i].held_out]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert out[None].predicted == 1 and not out[None].held_out and out[1000].predicted == 0 and 0 <= out[1001].score <= 1 and out[0].toxic == 1
    import zlib
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in out.items() if i is not None)
    flipped = tags.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x.doc_id: x.score for x in toxicity.score_toxicity(df, flipped).collect()} == {i: x.score for i, x in out.items()}  # held-out labels are not read
    none = toxicity.score_toxicity(df.limit(5), tags.limit(0)).collect()
    assert all(x.predicted == 0 for x in none) and toxicity.score_toxicity(df.limit(0), tags).count() == 0


def test_toxicity_sees_disguised_forms(spark):
    r = random.Random(5)
    plain = ["tree", "house", "river", "stone", "cloud", "bread", "light", "water", "you", "are", "i", "a", "all", "well"]
    bad = ["idiot", "loser", "moron", "stupid", "shit", "hate"]
    fill = [" ".join(r.choice(plain) for _ in range(30)) for _ in range(800)]
    docs = [(i, f"{x} {r.choice(bad)} {x} {r.choice(bad)}" if i % 4 == 0 else x) for i, x in enumerate(fill)]
    forms = ["you are a i d i o t", "water I i d i o t", "tree s t u p i d i d i o t", "tree s t u p i d m o r o n tree", "5h17", "1d107", "h473", "stuupid", "mooron", "idi-ot", "l.o.s.e.r", "st_upid", "$h1+"]
    clean = ["you are a t r e e", "well-a", "2024 a", "all well!", "h0u5e", "w4ter", "r-i-v-e-r", "stoone"]
    x = " ".join(["tree house river stone cloud bread light water"] * 3)
    probes = [(10_000 + k, f"{x} {w} {x}") for k, w in enumerate(forms + clean)]
    df = spark.createDataFrame(docs + probes, "doc_id long, text string")
    tags = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    out = {o.doc_id: o.predicted for o in toxicity.score_toxicity(df, tags).collect()}
    assert {w: out[10_000 + k] for k, w in enumerate(forms + clean)} == dict.fromkeys(forms, 1) | dict.fromkeys(clean, 0)


def test_held_out_accuracy_on_the_table(spark):
    sf = f"{SF_SMALL}/../sf0.1"
    scored = registry.op5_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((scored.score >= 0.5) == scored.toxic).mean() > 0.97
    assert scored[scored.predicted == 1].toxic.mean() > 0.9 and scored[scored.toxic == 1].predicted.mean() > 0.85


def test_chats_round_trip(spark):
    hostile = ["", None, "</turn>\n", "<|text|>", "<|role user|>", "%3C", "%253C", "# %", "\\### Assistant: </turn> ok", "é\n", "a|>b", "%7C|"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "</turn>", "# <|x|>"][(c + t) % 6], hostile[(5 * c + t) % len(hostile)], 1) for c in range(8) for t in range(40)]
    rows += [(9, 1, "user", "b", 1), (9, 0, "user", "a", 1), (9, 1, "user", "b", 1), (None, 0, "assistant", "n", 1), (10, None, "user", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segments int")
    formatted = format_chats(df)
    got = {r.conv_id: [tuple(x) for x in r.back] for r in formatted.select("conv_id", read_back(F.col("formatted")).alias("back")).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    digest = {r.conv_id: r for r in chat_digest(formatted).collect()}
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (digest[c].n_turns, digest[c].loss_chars) == (len(turns), len(loss))
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert digest[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert format_chats(df.limit(0)).count() == 0
    one = format_chats(df.filter("conv_id = 9")).first().formatted
    assert one == "<|role user|><|text|>a<|text|>b<|text|>b</turn>\n"  # neighbours of one role are one block


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, name):
    from tests.test_oracle import _digest
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF_SMALL).toPandas(), con.execute(registry.ORACLES[name]).df()
    for df in (got, want):
        for c in df.columns:
            if str(df[c].dtype) == "Int64" or (c in ("first_word", "last_word")):
                df[c] = df[c].astype("float64")
    assert _digest(got) == _digest(want)
