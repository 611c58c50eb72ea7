"""Operator 5 against brute force: all paths of small lattices, every word decoded, and the score from plain counts."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import toxicity
from tallyframe.llm.registry import read
from tallyframe.llm.textcore import mix, span_hashes
from tests.conftest import SF_SMALL

EDGES = (b".,;:?\"([{#&%", b".,;:?\")]}#&%!")


def lattice(word):
    """Per byte of a stretch, its (symbol or nothing, cost of the change)."""
    out = []
    for at, byte in enumerate(word):
        sign = chr(byte)
        if toxicity.LETTER[byte]:
            doubled = at > 0 and word[at - 1] == byte
            out.append([(byte, 0.0)] + [(None, 1.0 if at > 1 and word[at - 2] == byte else 4.0)] * doubled)
        elif sign == " " or sign in toxicity.SEPARATORS:
            out.append([(ord(x), 1.0) for x in toxicity.LOOKS_LIKE.get(sign, "")] + [(None, 0.5), (ord(" "), toxicity.BREAK_COST)])
        else:
            out.append([(ord(x), 1.0) for x in toxicity.LOOKS_LIKE.get(sign, "")] + [(None, 14.0)])
    return out


def all_paths(word, cost):
    """(cost, reading) of every path, cheapest first."""
    found = []
    for path in itertools.product(*lattice(word.lstrip(EDGES[0]).rstrip(EDGES[1]))):
        text = bytes(x for x, _ in path if x is not None)
        s = [0, 0, *(toxicity.SYMBOL[x] for x in text), 0]
        trigrams = sum(cost[(s[i] * toxicity.K + s[i + 1]) * toxicity.K + s[i + 2]] for i in range(len(s) - 2))
        found.append((trigrams + sum(c for _, c in path), text))
    return sorted(found)


@pytest.mark.parametrize("n", [1, 3, toxicity.READINGS])
def test_readings_are_the_cheapest_paths(n):
    rng = random.Random(n)
    cost = np.random.default_rng(n).uniform(0.1, 9, toxicity.K ** 3).tolist()
    words = [b"", b".", b"a", b"1d1ot", b"s*t*r", b"a i d", b"b00oo", b"x-*|", b"..(k)!", b"\xc3\xa9tat", b"aaa"]
    words += ["".join(rng.choice("aabbcz0134@$!|+(*.-_~' ") for _ in range(rng.randint(1, 6))).encode() for _ in range(150)]
    for word in words:
        want, got = all_paths(word, cost)[:n], toxicity.readings(word, cost, n)
        assert [c for c, _ in got] == pytest.approx([c for c, _ in want], abs=1e-9), word
        assert sorted(t for _, t in got) == sorted(t for _, t in want), word


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text or "").encode()


def words_of(text, cost):
    """All words of a text, plain and restored, with every word and every row of three one-letter words decoded: no gates."""
    raw = lower(text)
    plain = re.findall(rb"[a-z\x80-\xbf\xc2-\xf4]+", raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    inner = [len(w) == 1 and bool(toxicity.LETTER[w[0]] or chr(w[0]) in toxicity.LOOKS_LIKE) for w in words]
    rows, at = [w for w in words if len(w) > 1], 0
    for single, run in itertools.groupby(inner):
        size = len(list(run))
        if single and size >= 3:
            rows.append(b" ".join(words[at: at + size]))
        at += size
    return plain, [w for r in rows for w in toxicity._revealed(r, cost)]


def disguised(rng, text):
    """A text in which some words are spelt with signs, spaces and doubled letters."""
    back = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
    out = []
    for w in text.split(" "):
        kind = rng.random()
        if kind < 0.1:
            w = "".join(back.get(c, c) if rng.random() < 0.6 else c for c in w)
        elif kind < 0.15:
            w = " ".join(w[:12])
        elif kind < 0.2:
            w = rng.choice(".-_*").join(w[:12])
        elif kind < 0.25:
            w = "".join(c * rng.choice((1, 1, 2, 3)) for c in w)
        out.append(w)
    return " ".join(out)


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels")
    return docs, labels, toxicity.learn(docs, labels)


@pytest.fixture(scope="module")
def texts(learnt):
    rng = random.Random(2)
    some = [r.text for r in learnt[0].orderBy("doc_id").limit(60).collect()]
    return [*some, *(disguised(rng, t) for t in some if t), None, "", " \n", "a b", "a b c", "é é é", "1", "111", "aa", "xx yy", "a.b.c", "-word", "word-", "don't stop", "i 1 l"]


def test_no_disguised_word_is_passed_over(learnt, texts):
    cost = learnt[2].cost
    costs = cost.tolist()
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    doc, h, begin, count = toxicity.features(batch, "text", cost)
    got = sorted(zip(doc.tolist(), h.tolist(), begin.tolist(), strict=True))
    got = {i: sorted(v[1:] for v in rows) for i, rows in itertools.groupby(got, lambda v: v[0])}
    for i, text in enumerate(texts):
        plain, made = words_of(text, costs)
        assert count[i] == len(plain)
        assert got.get(i, []) == sorted(hashes(w) for w in [*plain, *made]), (text, made)


def hashes(word):
    buf = np.frombuffer(word, np.uint8)
    whole, begin = (span_hashes(buf, np.array([0]), np.array([n]))[0] for n in (len(word), min(len(word), toxicity.PREFIX)))
    return int(whole), int(mix(np.array([begin], np.uint64) + np.uint64(0xBE61))[0])


def test_scores_follow_from_counted_words(spark, learnt, texts):
    docs, labels, model = learnt
    costs, weights = model.cost.tolist(), dict(zip(model.known.tolist(), model.weight.tolist(), strict=True))
    assert 0 < len(weights) < toxicity.LEXICON_SIZE  # the limit does not bind
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    x = toxicity._measures(batch, "text", model)
    for i, text in enumerate(texts):
        plain, made = words_of(text, costs)
        hits = [(w, max(weights.get(k, 0.0) for k in hashes(w))) for w in [*plain, *made]]
        hits = [(w, v) for w, v in hits if v > 0]
        want = [1.0, max((v for _, v in hits), default=0.0), math.log1p(sum(dict(hits).values())),
                math.log1p(100 * sum(v for _, v in hits) / (len(plain) + 5))]
        assert x[i].tolist() == pytest.approx(want, abs=1e-9), text
    # the operator's scores are the logistic function of these measures
    rows = docs.orderBy("doc_id").limit(60).select("doc_id", "text").collect()
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).where(F.col("doc_id").isin([r.doc_id for r in rows])).collect()}
    for r, measures in zip(rows, x[:60], strict=True):
        p = 1 / (1 + math.exp(-float(measures @ model.fit)))
        assert scored[r.doc_id].score == pytest.approx(p, abs=1e-6)
        assert scored[r.doc_id].predicted == int(scored[r.doc_id].score >= 0.5)


def test_a_text_reads_the_same_beside_any_other(learnt, texts):
    cost = learnt[2].cost
    ends = ["aa", "bee", "stuff", "oo x", "x ee", "b", "", "e", "1"]
    for a, b, c in itertools.product(ends, repeat=3):
        together = toxicity.features(pa.RecordBatch.from_pydict({"text": [a, b, c]}), "text", cost)
        alone = toxicity.features(pa.RecordBatch.from_pydict({"text": [b]}), "text", cost)
        assert sorted(together[1][together[0] == 1].tolist()) == sorted(alone[1].tolist()), (a, b, c)
