"""License scan by a positional rare-token index (operator 4), in Spark expressions only.

Every template is indexed under the words of highest corpus IDF in its mandatory key phrase, with
their positions in the template. A file's words are looked up in that index; each posting proposes a start, proposals of one template are
intersected by that start, the mandatory key phrase is verified word by word, and the rest of the
template is scored by the IDF mass that stands where it should. The index and the document
frequencies are one small row, read as a scalar subquery; files are not shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Template(NamedTuple):
    label: str
    words: str
    phrase: str  # mandatory: its words stand consecutively
    base: bool = False


# License phrases and the labels they stand for. No word holds a letter that another
# one becomes in lower case (such as the Kelvin sign), so lower() acts on them as on A-Z alone.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
)
#: Words of its mandatory phrase that a template is indexed under.
KEYS = 2
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def phrase_at(t: Template) -> int:
    words, phrase = t.words.split(), t.phrase.split()
    return next(i for i in range(len(words)) if words[i: i + len(phrase)] == phrase)


def in_phrase(t: Template, rel: int) -> bool:
    """Whether the word at a place of a template belongs to its mandatory phrase."""
    return phrase_at(t) <= rel < phrase_at(t) + len(t.phrase.split())


def rare_token_index(df: DataFrame, text: str, templates: tuple[Template, ...]) -> Column:
    """One struct: ``keys`` (word -> postings (template, position)) and ``idf`` (word -> weight), by all documents of ``df``."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    present = df.select(F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(vocabulary))).alias("present"))
    # every word of the vocabulary has a row, with the number of documents that hold it
    counts = present.select(F.explode(F.concat(F.col("present"), F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = counts.agg(F.max(F.when(F.col("word") == "", F.col("df")))).scalar()
    slots = [F.struct(F.lit(i).alias("template"), F.lit(r).alias("rel"), F.lit(w).alias("word"), F.lit(in_phrase(t, r)).alias("mandatory"))
             for i, t in enumerate(templates) for r, w in enumerate(t.words.split())]
    table = df.sparkSession.range(1).select(F.inline(F.array(*slots)))
    weighed = table.join(counts, "word", "left").select("template", "rel", "word", "mandatory", (F.log((F.coalesce(n, F.lit(0)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    idf = weighed.agg(F.map_from_entries(F.collect_set(F.struct("word", "idf"))).alias("idf"))
    ranked = (weighed.filter("mandatory").groupBy("template").agg(F.array_sort(F.collect_list(F.struct((-F.round("idf", 9)).alias("low"), "rel", "word"))).alias("ranked"))
              .select("template", F.explode(F.slice("ranked", 1, KEYS)).alias("key")))
    keys = (ranked.groupBy(F.col("key.word").alias("word")).agg(F.array_sort(F.collect_list(F.struct("template", F.col("key.rel").alias("rel")))).alias("postings"))
            .agg(F.map_from_entries(F.collect_list(F.struct("word", "postings"))).alias("keys")))
    return F.struct(keys.scalar().alias("keys"), idf.scalar().alias("idf"))


def scan_licenses(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``df`` with ``n_words``, ``places`` (template, start, base, label, verified, share) and the columns derived from them.

    Derived are ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``;
    columns of these names are replaced. A null text is empty; a text without a proposed place has
    score 0. Only the mandatory phrase has to lie in the text: a start is negative where the template
    would begin before it, and the words missing there count as not in place. A share is the IDF mass of the template's words that stand in place; the score is the
    largest share, halved where the mandatory phrase is not complete.
    """
    added = ("n_words", "places", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    df = df.drop(*(c for c in added if c != text))
    names = df.columns
    index = rare_token_index(df, text, templates)
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    details = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.split(F.lit(t.words), " ").alias("words"),
                                 F.split(F.lit(t.phrase), " ").alias("phrase"), F.lit(phrase_at(t)).alias("at")) for t in templates))
    # inline() of one row keeps what was computed from being computed again by each of its readers
    read = df.select(*names, F.inline(F.array(F.struct(words_of(F.col(text)).alias("__lic_words")))))
    hits = F.filter(F.transform("__lic_words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    read = read.select(*names, F.inline(F.array(F.struct(F.col("__lic_words"), hits.alias("__lic_hits"), F.when(F.size(hits) > 0, index).alias("__lic_index"), details.alias("__lic_details")))))
    proposed = F.array_distinct(F.flatten(F.transform(
        F.filter("__lic_hits", lambda h: F.map_contains_key("__lic_index.keys", h["word"])),
        lambda h: F.filter(F.transform(F.col("__lic_index.keys")[h["word"]], lambda p: F.struct(p["template"].alias("template"), (h["at"] - p["rel"]).alias("start"))),
                           lambda p: p["start"] + F.col("__lic_details")[p["template"]]["at"] >= 0))))

    def examined(p):
        t = F.col("__lic_details")[p["template"]]
        share = F.aggregate(F.transform(t["words"], lambda w, k: F.when(F.get("__lic_words", p["start"] + k) == w, F.col("__lic_index.idf")[w]).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
        whole = F.aggregate(t["words"], F.lit(0.0), lambda a, w: a + F.col("__lic_index.idf")[w])
        right = F.forall(F.transform(t["phrase"], lambda w, k: F.coalesce(F.get("__lic_words", p["start"] + t["at"] + k) == w, F.lit(False))), lambda x: x)
        return F.struct(p["template"].alias("template"), p["start"].alias("start"), t["base"].alias("base"), t["label"].alias("label"), right.alias("verified"), (share / whole).alias("share"))

    read = read.select(*names, F.size("__lic_words").cast("long").alias("n_words"), F.inline(F.array(F.struct(
        F.when(F.size("__lic_hits") > 0, F.transform(proposed, examined)).otherwise(F.transform(F.filter(proposed, lambda p: F.lit(False)), examined)).alias("places")))))
    verified = F.filter("places", lambda p: p["verified"])
    base = F.filter(verified, lambda p: p["base"])

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"]))), ",")

    return read.select(
        *names, "n_words", "places", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(verified).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"] * F.when(p["verified"], 1.0).otherwise(0.5))), F.lit(0.0)).alias("score"))
