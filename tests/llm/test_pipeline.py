"""The corpus pipeline against brute force, stage by stage, and its run as a whole."""

import collections

from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import registry
from tallyframe.llm.blocks import written
from tallyframe.llm.toxicity import score_toxicity
from tests.conftest import SF_SMALL

from . import brute
from .test_text_operators import check_pieces


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    # toxicity: what the scores say goes, all else stays as it is
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).filter("predicted = 1").collect()}
    want = [r for r in rows(docs) if r[0] not in toxic]
    stage = iter(corpus_pipeline.STAGES)
    docs = written(spark, next(stage)[1](spark, docs, SF_SMALL), "t-stage")
    assert docs.columns == columns and sorted(rows(docs)) == sorted(want) and toxic
    # near duplicates: the smallest id of each component stays
    found = brute.near_groups([r[:2] for r in want])
    want = [r for r in want if found[r[0]][1] == r[0]]
    docs = written(spark, next(stage)[1](spark, docs, SF_SMALL), "t-stage")
    assert docs.columns == columns and sorted(rows(docs)) == sorted(want)
    # substring dedup: kept words, and untouched texts as they were
    kept = brute.remove_repeats([r[:2] for r in want])
    after = []
    for i, text, lang, source, n in want:
        if len(kept[i]) < len(brute.words(text)):
            text = " ".join(kept[i])
            n = len(text)
        if kept[i] or text == "" or not brute.words(text):
            after.append((i, text, lang, source, n))
    docs = written(spark, next(stage)[1](spark, docs, SF_SMALL), "t-stage")
    assert docs.columns == columns and sorted(rows(docs)) == sorted(after)
    # mixing
    copies = brute.mixed([(r[0], r[3], r[1]) for r in after])
    docs = written(spark, next(stage)[1](spark, docs, SF_SMALL), "t-stage")
    assert docs.columns == columns and collections.Counter(rows(docs)) == collections.Counter({r: copies[r[0]] for r in after if copies[r[0]]})
    # packing
    library = Tokenizer.from_file(registry.BYTE_BPE)
    ids = {r[0]: [library.encode(r[1], add_special_tokens=False).ids] * copies[r[0]] for r in after if copies[r[0]]}
    pieces = next(stage)[1](spark, docs, SF_SMALL).collect()
    check_pieces(pieces, ids)
    assert next(stage, None) is None
    run = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert collections.Counter((p.doc_id, p.start, p.ids_crc32) for p in run) == collections.Counter((p.doc_id, p.start, p.ids_crc32) for p in pieces)


def test_stages_take_odd_tables(spark, tmp_path):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5), (None, "some text of its own", "en", "s", 20)]
    for k, data in enumerate((odd, [])):
        sf = str(tmp_path / f"sf{k}")
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.read.parquet(f"{SF_SMALL}/labels.parquet").limit(0).write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf)
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert (got.count() > 0) == bool(data)
