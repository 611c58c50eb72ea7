"""Toxicity by noisy-channel deobfuscation (operator 5).

* A character language model, trigram counts over the letters of all documents, is gathered first.
* Words that may be disguised (with a sign, a separator within or a letter twice in a row, and rows of
  words of one letter) become a lattice: a sign may stand for the letters it resembles, a repeated letter
  may fall away, a separator or space may fall away or part two words. The words of the Viterbi path
  under the language model are the restored words.
* Word and word-beginning weights are learned from labelled rows, from restored text, and a logistic
  score of a document's weights is fitted on the same rows. Rows with crc32(id as text) mod 5 = 0 are
  held out of all learning from labels. Scores see the text only.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import prepare, written
from .textcore import LOWER, Words, chunks, mix, signed, span_hashes, text_buffer, tidy

#: Labelled rows that learning reads at most (those of smallest hash), and the words and beginnings kept.
SAMPLE_ROWS = 50_000
LEXICON_SIZE = 8_192
MIN_Z = 4.0
PREFIX = 4

#: The letters a sign may stand for, and the signs that may stand between letters.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
SEPARATORS = ".-_*~'"

K = 64  # symbols of the language model: 0 no letter, 1-26 a-z, 27-58 later bytes of a character, 59 its first byte
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = 27 + (np.arange(0x40) & 31)
SYMBOL[0xC2:0xF5] = 59
LETTER = SYMBOL > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_NOT_LETTER = ~LETTER
_SYMBOLS = SYMBOL.tolist()
_LETTERS = re.compile(rb"[a-z\x80-\xbf\xc2-\xf4]+")
SPACE = 32
#: What a space or separator costs that stands for itself and parts two words.
BREAK_COST = 1.0
#: Readings that are taken of a row of words of one letter, and what they may cost more than the likeliest.
READINGS, READING_MARGIN = 8, 6.0


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters."""
    out = LOWER[buf]
    at = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[at] += 0x20
    return out


class Model(NamedTuple):
    """What scoring needs: costs of the language model, weights by hash, coefficients of the score."""

    cost: np.ndarray
    known: np.ndarray
    weight: np.ndarray
    fit: np.ndarray


def readings(word: bytes, cost, n: int = 1) -> list[tuple[float, bytes]]:
    """The ``n`` likeliest readings of a disguised stretch, words set apart by spaces, with their costs: Viterbi over its lattice, a state being the last two symbols."""
    word = word.lstrip(b".,;:?\"([{#&%").rstrip(b".,;:?\")]}#&%!")
    states: dict = {(0, 0): [(0.0, None)]}  # cost so far, and the path as (path before, byte)
    for at, byte in enumerate(word):
        sign = chr(byte)
        options = []  # (letter, space or nothing, cost of the change)
        if LETTER[byte]:
            options.append((byte, 0.0))
            if at and word[at - 1] == byte:
                options.append((0, 1.0 if at > 1 and word[at - 2] == byte else 4.0))
        else:
            options += [(ord(x), 1.0) for x in LOOKS_LIKE.get(sign, "")]
            if sign in SEPARATORS or sign == " ":
                options += [(0, 0.5), (SPACE, BREAK_COST)]
            else:
                options.append((0, 14.0))
        following: dict = {}
        if n == 1:  # the same with one path a state
            for (p, q), [(sofar, path)] in states.items():
                for letter, change in options:
                    if letter:
                        r = _SYMBOLS[letter]
                        state, total, longer = (q, r), sofar + change + cost[(p * K + q) * K + r], (path, letter)
                    else:
                        state, total, longer = (p, q), sofar + change, path
                    held = following.get(state)
                    if held is None or total < held[0][0]:
                        following[state] = [(total, longer)]
            states = following
            continue
        for (p, q), paths in states.items():
            for letter, change in options:
                if letter:
                    r = _SYMBOLS[letter]
                    change += cost[(p * K + q) * K + r]
                    following.setdefault((q, r), []).extend([(sofar + change, (path, letter)) for sofar, path in paths])
                else:
                    following.setdefault((p, q), []).extend([(sofar + change, path) for sofar, path in paths])
        states = {k: sorted(v, key=_cost)[:n] if len(v) > 1 else v for k, v in following.items()}
    ends = sorted(((total + cost[(p * K + q) * K], path) for (p, q), paths in states.items() for total, path in paths), key=_cost)
    return [(total, _spelt(path)) for total, path in ends[:n]]


_cost = itemgetter(0)


def _spelt(path) -> bytes:
    out = bytearray()
    while path:
        path, letter = path
        out.append(letter)
    return bytes(out[::-1])


def restored(word: bytes, cost) -> bytes:
    return readings(word, cost)[0][1]


def _revealed(stretch: bytes, cost) -> tuple[bytes, ...]:
    """The words of a stretch's likely readings that do not stand in it plainly; in a row of letters several are open."""
    found = readings(stretch, cost, READINGS if b" " in stretch else 1)
    words = {w for total, path in found if total <= found[0][0] + READING_MARGIN for w in path.split()}
    return tuple(sorted(words - set(_LETTERS.findall(stretch))))


_reader: tuple = (None, None)


def _read(cost: np.ndarray):
    """``_revealed`` under one model, kept per process, so that a task decodes a distinct word once."""
    global _reader
    if _reader[0] is not cost:
        costs = cost.tolist()
        _reader = (cost, lru_cache(maxsize=200_000)(lambda w: _revealed(w, costs)))
    return _reader[1]


def _stay(buf: np.ndarray, first: np.ndarray, double: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The doubled letters that the likeliest reading keeps for certain, by the three trigrams they change.

    In one row of letters, a letter that stands twice, not three times, is kept or not by itself: a
    word of such a row whose doubled letters all stay reads as it stands. ``first`` tells where texts begin and end:
    beyond those stand no letters, so a text reads the same whatever its neighbours are.
    """
    wide = np.concatenate([[0, 0], buf, [0]]).astype(np.uint8)
    a, b, c = (SYMBOL[wide[k: k + len(buf)]] for k in (0, 1, 3))  # before the two, the letter, after them
    a[1:][first[: len(buf)][:-1]] = 0
    c[first[1: len(buf) + 1]] = 0
    triple = (wide[:-3] == buf) | (wide[3:] == buf)
    kept = cost[(a * K + b) * K + b] + cost[(b * K + b) * K + c]
    return double & ~triple & (kept < cost[(a * K + b) * K + c] + 4.0 - 1e-4)


def _flagged(words: Words, buf: np.ndarray, off: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the stretches that look disguised: words, and rows of words of one letter."""
    letter, sign = LETTER[buf], _SIGN[buf]
    inner = letter | sign
    double = np.zeros(len(buf), bool)
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    double[1:] = letter[1:] & (buf[1:] == buf[:-1]) & (buf[1:] < 0x80) & ~first[1:-1]
    opens, closes = _SEPARATOR[buf], _SEPARATOR[buf]  # separators after and before a letter or sign
    opens[1:] &= inner[:-1]
    closes[:-1] &= inner[1:]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    total = [np.concatenate([[0], np.cumsum(x)]) for x in (sign, opens, closes, double, double & ~_stay(buf, first, double, cost), begins)]
    signs, opened, closed, doubles, unsure, rows = (t[words.end] - t[words.start] for t in total)
    # a sign, a separator within, or a letter twice in a row, but for words that surely read as they stand
    odd = (signs > 0) | ((opened > 0) & (closed > 0)) | (unsure > 0) | ((doubles > 0) & (rows > 1))
    alone = np.flatnonzero(odd & (words.end - words.start > 1))
    doc = np.searchsorted(words.first, np.arange(len(words.start)), "right") - 1
    single = (words.end - words.start == 1) & inner[words.start] if len(words.start) else np.zeros(0, bool)
    run = np.ones(len(single), bool)
    run[1:] = (single[1:] != single[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(run)
    size = np.diff(np.append(at, len(single)))
    spaced = at[(size >= 3) & single[at]] if len(at) else at
    length = size[(size >= 3) & single[at]] if len(at) else size
    return (np.concatenate([words.start[alone], words.start[spaced]]), np.concatenate([words.end[alone], words.end[spaced + length - 1]]),
            np.concatenate([doc[alone], doc[spaced]]))


def features(batch: pa.RecordBatch, text: str, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word hash, hash of its beginning) of all words, plain and restored; and the words per document."""
    buf, off = text_buffer(batch.column(text))
    buf = lowered(buf)
    plain = Words(buf, off, _NOT_LETTER)
    count = np.diff(plain.first)
    doc = np.repeat(np.arange(len(count)), count)
    h = plain.hashes()
    begin = span_hashes(buf, plain.start, np.minimum(plain.end, plain.start + PREFIX))
    start, end, owner = _flagged(Words(buf, off), buf, off, cost)
    if len(start):
        read, raw = _read(cost), buf.tobytes()
        made = [(o, w) for a, b, o in zip(start.tolist(), end.tolist(), owner.tolist(), strict=True) for w in read(raw[a:b])]
        flat = np.frombuffer(b"".join(w for _, w in made), np.uint8)
        ends = np.cumsum([len(w) for _, w in made], dtype=np.int64)
        starts = ends - np.array([len(w) for _, w in made], np.int64)
        doc = np.concatenate([doc, np.array([o for o, _ in made], np.int64)])
        h = np.concatenate([h, span_hashes(flat, starts, ends)])
        begin = np.concatenate([begin, span_hashes(flat, starts, np.minimum(ends, starts + PREFIX))])
    return doc, h, mix(begin + np.uint64(0xBE61)), count


def _measures(batch: pa.RecordBatch, text: str, model: Model) -> np.ndarray:
    """Per document the inputs of the score: 1, and the largest, the sum and the share of its weights."""
    doc, h, begin, count = features(batch, text, model.cost)
    weight = np.maximum(_looked_up(h, model), _looked_up(begin, model))
    hit = weight > 0
    doc, h, weight = doc[hit], h[hit], weight[hit]
    n = batch.num_rows
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, doc, weight)
    _, once = np.unique(np.stack([doc.astype(np.uint64), h], 1), axis=0, return_index=True) if len(doc) else (0, np.zeros(0, int))
    np.add.at(total, doc[once], weight[once])
    often = np.bincount(doc, weights=weight, minlength=n)
    return np.stack([np.ones(n), most, np.log1p(total), np.log1p(100 * often / (count + 5))], 1)


def _looked_up(h: np.ndarray, model: Model) -> np.ndarray:
    if not len(model.known):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(model.known, h), len(model.known) - 1)
    return np.where(model.known[at] == h, model.weight[at], 0.0)


def _language_costs(df: DataFrame, text: str) -> np.ndarray:
    """-log P(symbol | the two before) from the trigrams of all documents, smoothed; K**3 numbers whatever the input."""

    def count(batches):
        seen = np.zeros(K ** 3, np.int64)
        for batch in batches:
            for part in chunks(batch, text):
                buf, off = text_buffer(part.column(text))
                # two gaps before each text and one after it, so that no trigram spans two texts
                s = np.zeros(len(buf) + 2 * len(off), np.int64)
                s[np.arange(len(buf)) + 2 * np.repeat(np.arange(1, len(off)), np.diff(off))] = SYMBOL[lowered(buf)] if len(buf) else 0
                seen += np.bincount((s[:-2] * K + s[1:-1]) * K + s[2:], minlength=K ** 3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": seen[at]})

    rows = df.select(text).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(K ** 3)
    for r in rows:
        n[r["gram"]] = r["n"]
    three = n.reshape(K, K, K)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 1) / (one.sum() + K)
    p2 = (two + 8 * p1) / (two.sum(1, keepdims=True) + 8)
    p3 = (three + 4 * p2) / (three.sum(2, keepdims=True) + 4)
    return -np.log(p3).ravel().astype(np.float32)


def _lexicon(rows: DataFrame, text: str, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and beginnings that toxic rows hold more often, and their log odds."""

    def count(batches):
        for batch in batches:
            for part in chunks(batch, text, 4 << 20):
                doc, h, begin, _ = features(part, text, cost)
                pairs = np.unique(np.stack([np.concatenate([doc, doc]).astype(np.uint64), np.concatenate([h, begin])], 1), axis=0)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[pairs[:, 0].astype(np.int64)] > 0
                value, own = np.unique(pairs[:, 1], return_inverse=True)
                yield pa.RecordBatch.from_pydict({"h": signed(value), "toxic": np.bincount(own, toxic, len(value)).astype(np.int64), "clean": np.bincount(own, ~toxic, len(value)).astype(np.int64)})
        tidy()

    sizes = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = float(sizes["t"] or 0), float(sizes["n"])
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (n - t + 1))
    found = (rows.select(text, "toxic").mapInArrow(count, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .filter("toxic > 1").withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5) * 0.25))
             .filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "h").limit(LEXICON_SIZE).select("h", "odds").collect())
    known = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r["odds"] for r in found])[order]


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; without rows of both kinds the smoothed share of toxic rows."""
    w = np.zeros(4)
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    if not 0 < y.sum() < len(y):
        return w
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.diag([1e-3, 1, 1, 1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model of ``df``'s language and of ``labels`` (key, toxic): at most ``SAMPLE_ROWS`` labelled rows, none held out."""
    cost = _language_costs(df, text)
    sample = (labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias(key)).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
              .orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS))
    rows = written(df.sparkSession, df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).join(F.broadcast(sample), key), "labelled")
    known, weight = _lexicon(rows, text, cost)
    draft = Model(cost, known, weight, np.zeros(4))

    def measure(batches):
        for batch in batches:
            for part in chunks(batch, text):
                x = _measures(part, text, draft)
                yield pa.RecordBatch.from_pydict({"y": part.column("toxic"), **{f"x{i}": x[:, i] for i in range(4)}})

    table = rows.select(text, "toxic").mapInArrow(measure, "y long, x0 double, x1 double, x2 double, x3 double").toArrow()
    x = np.stack([table.column(f"x{i}").to_numpy() for i in range(4)], 1)
    return draft._replace(fit=_fitted(x, table.column("y").to_numpy().astype(float)))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with ``held_out``, ``score`` and ``predicted``; columns of these names are replaced.

    A null text is scored as an empty one. A row without an id is not held out and never labelled;
    of several labels of one id the largest holds. Without labels of both kinds all scores are the
    smoothed share of toxic labels.
    """
    spark = df.sparkSession
    prepare(spark)
    df = df.drop(*(c for c in ("held_out", "score", "predicted") if c not in (text, key)))
    model = spark.sparkContext.broadcast(tuple(learn(df, labels, text, key)))  # K**3 costs and LEXICON_SIZE weights at most
    names = df.columns

    def score(batches):
        held = Model(*model.value)
        for batch in batches:
            for part in chunks(batch, text):
                p = 1 / (1 + np.exp(-np.clip(_measures(part, text, held) @ held.fit, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(p)], [*names, "score"])
        tidy()

    out = df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.select(*names, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

