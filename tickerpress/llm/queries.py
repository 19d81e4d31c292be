"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerpress.llm import (ann, conversation_repair, embedding_dedup, html_extraction, mixing, packing, prefix_trie, sentencepiece_codec,
                             sharding, simhash, substring_dedup, token_files, toxicity)
from tickerpress.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_table(spark, sf_dir, "documents")).drop("kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(_table(spark, sf_dir, "documents"),
                                             public_tokenizers.path("piece_bpe_32k.model"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = token_files.write_segments(_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"),
                                          public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(segments)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversation_repair.damage(conversations), conversations)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.rebuilt_turns(_table(spark, sf_dir, "conversations"))
    ends = prefix_trie.ends_digest(prefix_trie.members(turns))
    nothing = F.sha2(F.lit(""), 256)
    return prefix_trie.build_trie(turns).join(ends, "whole", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_simhash": op4_simhash,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_files": op8_token_files,
    "op9_nearest": op9_nearest,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Unsigned CRC-32 of an ASCII string, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1),
    lambda i: ord(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

ORACLES = {
    "op2_substring_dedup": r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM starts),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""",
    "op5_embedding_dedup": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.x = vec_id LEFT JOIN counts ON counts.x = vec_id
""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, {_CRC32.format("k")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM judged),
edits(letter, role, price) AS (VALUES ('D', NULL, 4), ('K', NULL, 0), ('R', 'user', 3), ('R', 'assistant', 3)),
moves(state, initial, into_state) AS (
  VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
inserts(state, into_state, letters, price, texts) AS (
  VALUES ('-', '-', '', 0, ''), ('s', 's', '', 0, ''), ('u', 'u', '', 0, ''), ('a', 'a', '', 0, ''),
         ('-', 'u', 'I', 3, 'user:' || chr(10)), ('s', 'u', 'I', 3, 'user:' || chr(10)), ('a', 'u', 'I', 3, 'user:' || chr(10)),
         ('u', 'a', 'I', 3, 'assistant:' || chr(10)), ('-', 'a', 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)),
         ('s', 'a', 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10))),
scripts AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '-' AS state, 0::BIGINT AS cost, '' AS audit, '' AS texts FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit, texts FROM (
    SELECT f.conv_id, f.i, CASE WHEN e.letter = 'D' THEN n.into_state ELSE m.into_state END AS state,
           s.cost + n.price + e.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END AS cost,
           s.audit || n.letters || e.letter AS audit,
           s.texts || n.texts || CASE WHEN e.letter = 'D' THEN '' ELSE coalesce(e.role, f.role) || ':' || f.text || chr(10) END AS texts,
           row_number() OVER (
             PARTITION BY f.conv_id, CASE WHEN e.letter = 'D' THEN n.into_state ELSE m.into_state END
             ORDER BY s.cost + n.price + e.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END,
                      s.audit || n.letters || e.letter) AS place
    FROM scripts s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1
    JOIN inserts n ON n.state = s.state
    JOIN edits e ON e.letter = 'D' OR coalesce(f.fault, '') NOT IN ('blank', 'duplicate')
    LEFT JOIN moves m ON e.letter <> 'D' AND m.state = n.into_state AND m.initial = coalesce(e.role, f.role)[1]
    WHERE e.letter = 'D' OR m.into_state IS NOT NULL) WHERE place = 1),
lengths AS (SELECT conv_id, max(i) AS n FROM scripts GROUP BY conv_id),
ends AS (
  SELECT s.conv_id, s.cost + n.price AS cost, s.audit || n.letters AS audit, s.texts || n.texts AS texts,
         row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + n.price, s.audit || n.letters) AS place
  FROM scripts s JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.n = s.i
  JOIN inserts n ON n.state = s.state AND n.into_state IN ('-', 'a')),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(CASE WHEN texts = '' THEN '' ELSE texts[:-2] END) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id WHERE place = 1
""",
    "op13_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM turns),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS lender, {_CRC32.format("k")} % 6 AS h FROM ids),
parts AS (
  SELECT h.conv_id, 0 AS own, t.i, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.lender AND t.i <= h.h
  UNION ALL
  SELECT h.conv_id, 1, t.i, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.i > h.h),
rebuilt AS (
  SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY own, i) AS keys,
         list(length(text) ORDER BY own, i) AS chars FROM parts GROUP BY conv_id),
full_rows AS (
  SELECT conv_id, coalesce(keys, []) AS keys, coalesce(chars, []) AS chars FROM ids LEFT JOIN rebuilt USING (conv_id)),
spread AS (
  SELECT conv_id, keys[1:d] AS prefix, d AS depth, len(keys) = d AS ends_here, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM full_rows)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends_here), '')) AS ends_sha256
  FROM spread GROUP BY prefix, depth),
children AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix, depth)),
below AS (
  SELECT prefix[1:d] AS prefix, d AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY 1, 2)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (prefix, depth)
LEFT JOIN nodes p ON p.prefix = c.prefix[1:c.depth - 1] AND p.depth = c.depth - 1
""",
}
