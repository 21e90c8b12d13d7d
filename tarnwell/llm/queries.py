"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, lm
from .audio import audio_features, samples_of
from .common import cut, read
from .html_text import extract
from .jaccard import join_components
from .licenses import scan_licenses
from .mixing import mix
from .packing import pack
from .quality_rules import judge, learn_rules, measure
from .sharding import shard_slots
from .simhash import near_duplicates
from .tput import rank_documents
from .tries import prefix_trie


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio_features(read(spark, sf_dir, "documents")).withColumn("payload", samples_of(F.col("media")))
    voiced = F.expr("aggregate(segments, 0L, (a, s) -> a + s.end_ms - s.start_ms)")
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("segments").cast("string"), voiced.cast("string"), F.md5("tensors")).alias("feature"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measure(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    found = judge(measured, learn_rules(measured, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), "source", "lang", "topic", "tokens", "weight", "gap", "probability", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_slots(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = crf.score(docs, crf.learn(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_audio": op2_audio,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_classifier": op8_classifier,
    "op9_packing": op9_packing,
    "op10_html": op10_html,
    "op11_search": op11_search,
    "op12_trie": op12_trie,
    "op13_jaccard": op13_jaccard,
}
_OP11 = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
dfs AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term, docs),
asked AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""

_OP12 = r"""
WITH RECURSIVE turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS at,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS label,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id),
plan AS (SELECT c.conv_id, c.h, c.conv_id - c.conv_id % 20 AS base, least(c.h, coalesce(b.n, 0)) AS k FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
rebuilt AS (
  SELECT p.conv_id, t.at AS depth, label, words FROM plan p JOIN turns t ON t.conv_id = p.base AND t.at <= p.k
  UNION ALL SELECT p.conv_id, t.at - p.h + p.k, label, words FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.at > p.h),
paths AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, NULL::VARCHAR AS above, 0::BIGINT AS words FROM convs
  UNION ALL SELECT r.conv_id, r.depth, md5(p.node || r.label), p.node, r.words FROM paths p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ids
  FROM paths JOIN lengths USING (conv_id) GROUP BY node),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
subtrees AS (SELECT a.node, sum(CASE WHEN o.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved
  FROM own o JOIN paths a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY a.node)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(o.ids) AS ends_sha256
FROM own o JOIN subtrees s USING (node) LEFT JOIN own u ON u.node = o.above"""

_OP13 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM classes),
pairs AS (SELECT a.id AS x, b.id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached AS (SELECT id AS x, id AS y FROM classes UNION SELECT r.x, e.y FROM reached r JOIN edges e ON e.x = r.y),
labels AS (SELECT x AS id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN labels USING (id)"""

#: The others can't be said in DuckDB's SQL whole (hash functions, learned models, tokenizers): tests/llm holds them
#: against brute-force versions instead.
ORACLES: dict[str, str] = {"op11_search": _OP11, "op12_trie": _OP12, "op13_jaccard": _OP13}
