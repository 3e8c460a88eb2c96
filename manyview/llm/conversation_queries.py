"""Queries over conversations and the fingerprints of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm import conversation_trie, simhash
from manyview.llm.conversation_repair import Repair, damage
from manyview.llm.scratch import Scratch

# CRC-32 bit by bit, of a text column {0}
S_CRC = """
xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[((ascii(ch) >> b) & 1)::BIGINT FOR b IN range(8)] FOR ch IN string_split({0}, '')])),
    lambda a, b: CASE WHEN (xor(a, b) & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = conversation_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"), scratch)
    return conversation_trie.prefix_trie(*conversation_trie.with_shared_starts(turns, scratch), scratch).drop("level")


OP11_SQL = rf"""
WITH r AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {S_CRC.format("conv_id::VARCHAR")} % 4 AS h, n
  FROM (SELECT conv_id, count(*) AS n FROM r GROUP BY 1)
), k AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base
), rebuilt AS (
  SELECT k.conv_id, r.pos - k.h + k.taken AS d, t, words FROM k JOIN r ON r.conv_id = k.conv_id AND r.pos > k.h
  UNION ALL SELECT k.conv_id, r.pos, t, words FROM k JOIN r ON r.conv_id = k.base AND r.pos <= k.taken
), p AS (
  SELECT conv_id, d, words, md5(string_agg(t, ',') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM k
), q AS (
  SELECT *, lag(key) OVER w AS above, lead(key) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), nodes AS (
  SELECT key, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM q GROUP BY key, d
), kids AS (
  SELECT above AS key, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (key)
), sums AS (
  SELECT a.key, count(*) FILTER (b.kids = 0) AS leaves, sum((b.n - 1) * b.words)::BIGINT AS saved
  FROM full_nodes b JOIN p a ON a.conv_id = b.conv_id AND a.d <= b.d GROUP BY a.key
)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, n.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums USING (key) LEFT JOIN nodes m ON m.key = n.above
"""

def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fingerprint"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).report()


OP13_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {S_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations
), damaged AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM given
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM damaged
), judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
         lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY pos) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), put(before, middle, letters, names) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']),
         (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
), rules(middle, after, initial, name) AS (
  VALUES (0, 1, 's', ''), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (3, 2, 'u', 'user'), (2, 3, 'a', 'assistant')
), ways AS (
  SELECT before, after, initial, name, letters, names FROM put JOIN rules USING (middle)
  UNION ALL SELECT symbol, symbol, NULL, NULL, '', [] FROM (SELECT unnest(range(4)) AS symbol)
), chart AS (
  SELECT DISTINCT c, 0::BIGINT AS pos, 0 AS symbol, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM judged
  UNION ALL
  SELECT c, pos, symbol, cost, audit, lines FROM (
    SELECT t.c, t.pos, w.after AS symbol,
           t.cost + CASE WHEN w.initial IS NULL THEN 2 ELSE 5 * length(w.letters) + CASE WHEN j.cut THEN 5 ELSE 0 END + CASE WHEN w.initial = j.initial THEN 0 ELSE 1 END END AS cost,
           t.audit || w.letters || CASE WHEN w.initial IS NULL THEN 'D' WHEN w.initial = j.initial THEN 'K' ELSE 'R' END AS audit,
           CASE WHEN w.initial IS NULL THEN t.lines
                ELSE list_concat(t.lines, w.names, [CASE WHEN w.initial = j.initial THEN j.role ELSE w.name END || ':' || j.text]) END AS lines
    FROM (SELECT c, pos + 1 AS pos, symbol, cost, audit, lines FROM chart) t JOIN judged j ON j.c = t.c AND j.pos = t.pos JOIN ways w ON w.before = t.symbol
    WHERE w.initial IS NULL OR NOT (j.blank OR j.again) AND (w.initial = j.initial OR w.initial <> 's')
  ) QUALIFY row_number() OVER (PARTITION BY c, pos, symbol ORDER BY cost, audit) = 1
), sizes AS (
  SELECT c, count(*) AS pos, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY 1
), ends AS (
  SELECT c, cost + 5 * length(letters) AS cost, audit || letters AS audit, list_concat(lines, names) AS lines
  FROM chart JOIN sizes USING (c, pos) JOIN put ON before = symbol WHERE middle IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost + 5 * length(letters), audit || letters) = 1
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sizes s ON s.c = coalesce(g.conv_id::VARCHAR, '') LEFT JOIN ends e ON e.c = s.c
"""

QUERIES = {"op11_conversation_trie": op11_conversation_trie, "op12_simhash_dedup": op12_simhash_dedup, "op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op11_conversation_trie": OP11_SQL, "op13_conversation_repair": OP13_SQL}
