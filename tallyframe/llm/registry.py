"""The queries of this subpackage: ``opN_<name>`` applies operator N to its whole table; and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_digest, format_chats
from .conversation_repair import damaged, repair_report
from .embedding_dedup import near_vectors
from .licenses import DELIMITERS, KEYS, TEMPLATES, in_phrase, scan_licenses
from .merkle import lowered, manifest
from .mixing import mix_sources
from .mtree import top_k
from .ngram_join import near_groups
from .packing import pack_sequences
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import score_toxicity
from .url_filter import BRANCHES, ENDING, IDENTIFIER, MIN_SPLIT, NUMBER, PURITY, RULES, SUPPORT, WEIGHT, judge_urls

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "position", F.sha2("text", 256).alias("text_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


HOSTILE = r"\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return chat_digest(format_chats(turns.unionByName(hostile)))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"), BYTE_BPE)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), BYTE_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations, "conv_id", "turn", "role", "text")
    return repair_report(conversations, rows).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = {"text": F.when(tampered, lowered(F.col("text"))).otherwise(F.col("text"))}
    return manifest(read(spark, sf_dir, "documents"), changed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Oracles of operators that SQL expresses; the others are tested against brute force in tests/llm.

ORACLE_MIXING = """
WITH sizes AS (SELECT coalesce(source, '') AS s, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
whole AS (SELECT sum(CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0 END) AS raw, sum(size) AS size FROM sizes),
rates AS (SELECT s, pow(sizes.size, 0.5) / whole.raw * whole.size / sizes.size AS rate FROM sizes, whole WHERE sizes.size > 0),
parts AS (SELECT s, rate, unnest(range(1, greatest(1, ceil(rate / 16.0))::BIGINT + 1)) AS part, greatest(1, ceil(rate / 16.0)) AS n FROM rates),
ks AS (SELECT s, part, k, sum(exp(-rate / n + k * ln(rate / n) - lgamma(k + 1))) OVER (PARTITION BY s, part ORDER BY k) AS step
       FROM parts, (SELECT unnest(range(0, 97)) AS k)),
steps AS (SELECT s, part, list(step ORDER BY k) AS step FROM ks GROUP BY ALL),
draws AS (SELECT d.doc_id, d.source, d.text, sum(len(list_filter(t.step, lambda x: x <=
            ('0x' || substr(md5('42|' || coalesce(d.doc_id::VARCHAR, '') || '|' || t.part), 1, 13))::BIGINT / 4503599627370496.0))) AS n
          FROM documents d JOIN steps t ON coalesce(d.source, '') = t.s GROUP BY ALL)
SELECT doc_id, source, copy::INTEGER AS copy, md5('order 42|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS position, sha256(text) AS text_sha256
FROM (SELECT *, unnest(range(0, n::BIGINT)) AS copy FROM draws)
"""

_SLOTS = ", ".join(f"({i}, '{t.label}', {t.base}, {r}, '{w}', {in_phrase(t, r)})"
                   for i, t in enumerate(TEMPLATES) for r, w in enumerate(t.words.split()))
ORACLE_LICENSES = f"""
WITH w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{DELIMITERS}'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM w0),
t(template, label, base, rel, word, key_phrase) AS (VALUES {_SLOTS}),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM w WHERE word IN (SELECT word FROM t) GROUP BY 1),
weighed AS (SELECT t.*, ln((SELECT count(*) FROM documents) + 1) - ln(coalesce(df, 0) + 1) + 1 AS idf FROM t LEFT JOIN df USING (word)),
keyed AS (SELECT *, key_phrase AND row_number() OVER (PARTITION BY template, key_phrase ORDER BY round(idf, 9) DESC, rel) <= {KEYS} AS is_key,
    min(CASE WHEN key_phrase THEN rel END) OVER (PARTITION BY template) AS at FROM weighed),
proposed AS (SELECT DISTINCT w.doc_id, k.template, w.pos - k.rel AS start FROM w JOIN keyed k ON w.word = k.word AND k.is_key WHERE w.pos - k.rel + k.at >= 0),
examined AS (SELECT p.doc_id, p.start, p.template, any_value(k.label) AS label, bool_or(k.base) AS base,
    bool_and(CASE WHEN k.key_phrase THEN w.word IS NOT NULL ELSE true END) AS verified,
    sum(CASE WHEN w.word IS NOT NULL THEN k.idf ELSE 0 END) / sum(k.idf) AS share
  FROM proposed p JOIN keyed k USING (template) LEFT JOIN w ON w.doc_id = p.doc_id AND w.pos = p.start + k.rel AND w.word = k.word GROUP BY ALL)
SELECT d.doc_id, any_value(len(ws)) AS n_words, count(*) FILTER (verified AND base) AS n_base,
  min(start) FILTER (verified AND base) AS first_word, max(start) FILTER (verified AND base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified AND base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified), '') AS labels,
  coalesce(max(share * CASE WHEN verified THEN 1 ELSE 0.5 END), 0.0) AS score
FROM w0 d LEFT JOIN examined e USING (doc_id) GROUP BY d.doc_id
"""

ORACLE_CHAT = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(regexp_replace(text, '[%<#|]', '...', 'g')) AS text_chars, length(regexp_replace(role, '[%<#|]', '...', 'g')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + 8 + CASE WHEN opens THEN role_chars + 17 ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

ORACLE_TOP_K = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    return (f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)), "
            "lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))")


def _tree_sql(name: str, levels: int) -> str:
    """CTEs that grow the trees of ``name0`` (tree, place, n, digest), each node with its run's digests ``kids``; a tree of one node stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k}r AS (SELECT tree, place // 16 AS above, list(digest ORDER BY place) AS kids, any_value(n) AS n FROM {name}{k} GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS (SELECT tree, above AS place, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN kids[1] ELSE sha256(list_aggregate(kids, 'string_agg', '')) END AS digest FROM {name}{k}r)")
    return ",\n".join(out)


def _fold_sql(source: str, name: str, runs: str, levels: int) -> str:
    """CTEs that fold the rows of ``source`` (tree, place, node, proof) through the levels of a tree."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k} AS (SELECT s.* REPLACE (s.place // 16 AS place,
    CASE WHEN r.n = 1 THEN s.node ELSE sha256(coalesce(list_aggregate(r.kids[:s.place % 16], 'string_agg', ''), '') || s.node || coalesce(list_aggregate(r.kids[s.place % 16 + 2:], 'string_agg', ''), '')) END AS node,
    CASE WHEN r.n = 1 THEN s.proof ELSE s.proof || coalesce(list_aggregate(r.kids[:s.place % 16], 'string_agg', ''), '') || coalesce(list_aggregate(r.kids[s.place % 16 + 2:], 'string_agg', ''), '') END AS proof)
  FROM {source} s JOIN {runs}{k}r r ON r.tree = s.tree AND r.above = s.place // 16)""")
        source = f"{name}{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE_MERKLE = f"""
WITH docs AS (SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents),
l0 AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql("text")} AS digest, {_leaf_sql("changed")} AS replacement,
    row_number() OVER (PARTITION BY coalesce('=' || source, '') ORDER BY doc_id NULLS FIRST, {_leaf_sql("text")}) - 1 AS place, count(*) OVER (PARTITION BY coalesce('=' || source, '')) AS n FROM docs),
{_tree_sql("l", 6)},
t0 AS (SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree COLLATE "C") - 1 AS place, count(*) OVER () AS n FROM l6),
{_tree_sql("t", 3)},
s AS (SELECT doc_id, digest AS leaf, tree, place, replacement AS node, '' AS proof FROM l0),
{_fold_sql("s", "f", "l", 6)},
s2 AS (SELECT f5.* REPLACE ('' AS tree, t0.place AS place), t0.digest AS subroot FROM f5 JOIN t0 ON t0.of = f5.tree),
{_fold_sql("s2", "g", "t", 3)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = digest AS verified FROM g2, t3
"""

def _level_sql(d: int) -> str:
    """CTEs of one level of the template trees: from u<d> (host, path, label, segments, node, n) to u<d+1>."""
    segment, ending = f"segments[{d + 1}]", f"regexp_extract(path, '{ENDING}', 0)"
    return f"""
o{d} AS (SELECT *, CASE WHEN regexp_matches({segment}, '{NUMBER}') THEN '*' || regexp_extract({segment}, '{ENDING}', 0)
    WHEN regexp_matches({segment}, '{IDENTIFIER}') AND regexp_matches({segment}, '[0-9]') THEN '*' WHEN regexp_matches({segment}, '^\\*|\\+$') THEN '=' || {segment} || '=' ELSE {segment} END AS seen,
    coalesce(label, 'none') || '|' || (len(segments) - {d}) || '|' || {ending} AS kind FROM u{d} WHERE n >= {MIN_SPLIT} AND len(segments) > {d}),
b{d} AS (SELECT *, named AND NOT (count(*) FILTER (named) OVER (PARTITION BY host, node) > {BRANCHES} AND n < {SUPPORT}) AS kept
    FROM (SELECT host, node, seen, NOT starts_with(seen, '*') AS named, count(*) AS n FROM o{d} GROUP BY ALL)),
x{d} AS (SELECT *, first(kind) OVER (PARTITION BY host, node, seen ORDER BY x DESC, kind DESC) AS pool
    FROM (SELECT o.host, o.node, o.seen, kind, b.n, count(*) AS x FROM o{d} o JOIN b{d} b ON (o.host, o.node, o.seen) = (b.host, b.node, b.seen) WHERE kept GROUP BY ALL)),
p{d} AS (SELECT host, node, pool, kind, sum(x) AS p FROM x{d} GROUP BY ALL),
z{d} AS (SELECT host, node, pool, sum(p) AS whole, count(*) - 1 AS free FROM p{d} GROUP BY ALL),
a{d} AS (SELECT x.host, x.node, x.pool, x.seen FROM x{d} x JOIN p{d} p ON (x.host, x.node, x.pool, x.kind) = (p.host, p.node, p.pool, p.kind) JOIN z{d} z ON (x.host, x.node, x.pool) = (z.host, z.node, z.pool)
    GROUP BY ALL HAVING round(any_value(whole) / any_value(n) * sum(x * x / p) - any_value(n), 6) <= round(any_value(free) + 2 * sqrt(2 * any_value(free)), 6)),
m{d} AS (SELECT *, min(seen) OVER (PARTITION BY host, node, pool) || '+' AS merged FROM a{d} QUALIFY count(*) OVER (PARTITION BY host, node, pool) > 1),
t{d} AS (SELECT b.host, b.node, b.seen, b.n, CASE WHEN NOT kept THEN CASE WHEN starts_with(b.seen, '*') THEN b.seen ELSE '*' END ELSE coalesce(m.merged, b.seen) END AS branch
    FROM b{d} b LEFT JOIN m{d} m ON (b.host, b.node, b.seen) = (m.host, m.node, m.seen)),
u{d + 1} AS (SELECT o.host, path, label, segments, o.node || '/' || branch AS node, t.n
    FROM o{d} o JOIN (SELECT * REPLACE (sum(n) OVER (PARTITION BY host, node, branch) AS n) FROM t{d}) t ON (o.host, o.node, o.seen) = (t.host, t.node, t.seen))"""


def _closed_sql(d: int) -> str:
    return f"SELECT host, path, label, CASE WHEN n < {MIN_SPLIT} THEN node || '/**' ELSE node END AS template FROM u{d} WHERE n < {MIN_SPLIT} OR len(segments) <= {d}"


URL_LEVELS = 5  # of the oracle; the urls of the given tables have three segments at most
_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.text}', '{r.host}', '{r.path}')" for r in RULES)
ORACLE_URLS = f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
ruled AS (SELECT parts.*, (SELECT arg_max({{'rule': rule, 'verdict': verdict}}, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS r FROM parts),
u0 AS (SELECT *, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS segments, '' AS node, count(*) OVER (PARTITION BY host) AS n FROM (SELECT DISTINCT host, path, r.verdict AS label FROM ruled)),
{",".join(_level_sql(d) for d in range(URL_LEVELS))},
closed AS ({" UNION ALL ".join(_closed_sql(d) for d in range(URL_LEVELS + 1))}),
judged AS (SELECT host, path, template, (count(*) FILTER (label = 'block') OVER w + {WEIGHT / 2}) / (count(label) OVER w + {WEIGHT}) AS purity FROM closed WINDOW w AS (PARTITION BY host, template))
SELECT page_id, r.host, r.path, r.r.rule AS rule, coalesce(r.r.verdict, CASE WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, template, purity
FROM ruled r JOIN judged j ON r.host = j.host AND r.path = j.path
"""

ORACLES: dict[str, str] = {"op11_url_filter": ORACLE_URLS, "op13_merkle_manifest": ORACLE_MERKLE, "op3_exact_top_k": ORACLE_TOP_K, "op1_mixing": ORACLE_MIXING, "op4_license_scan": ORACLE_LICENSES, "op6_chat_format": ORACLE_CHAT}
