"""A corpus pipeline out of the operators of ``tallyframe.llm``: toxic documents go, one document of each near-duplicate group stays,
repeated passages are cut, sources are mixed to their target weights, and the result is packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.blocks import written
from tallyframe.llm.mixing import mix_sources
from tallyframe.llm.ngram_join import near_groups
from tallyframe.llm.packing import pack_sequences
from tallyframe.llm.registry import BYTE_BPE, read
from tallyframe.llm.substring_dedup import remove_repeats
from tallyframe.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component; documents without an id stay."""
    copies = written(spark, near_groups(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones; one of which nothing is left goes."""
    cut = remove_repeats(docs).filter("n_removed = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents such that sources have their target weights, in random order."""
    return mix_sources(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    return pack_sequences(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages of toxicity and packing have no SQL form; tests/llm holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each one's rows stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
