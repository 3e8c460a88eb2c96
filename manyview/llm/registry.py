"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm import conversation_queries, language_id, quality
from manyview.llm.decontamination import leaks
from manyview.llm.html_text import extract_text
from manyview.llm.license_scan import scan_licenses
from manyview.llm.line_dedup import drop_repeated_lines
from manyview.llm.mixing import mix_sources
from manyview.llm.near_dedup import near_duplicates
from manyview.llm.substring_dedup import drop_repeated_windows
from manyview.llm.text_columns import fold_of
from manyview.llm.topk_search import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__sub_words").alias("n_words"),
        F.col("__sub_removed").alias("n_removed"),
        F.col("__sub_sha256").alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), spans AS (
  SELECT doc_id, i FROM windows JOIN again USING (h)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM spans
), tokens AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS text, count(*) AS n
  FROM tokens t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos WHERE g.pos IS NULL GROUP BY t.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that holds an item of the benchmark."""
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.groupBy(F.col("id").alias("doc_id")).agg(
        F.count_distinct("item").alias("n_items"),
        F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",").alias("item_ids"),
        F.max("covered").alias("covered"),
        F.max("same").alias("verbatim"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", F.col("__html_text").alias("text"), F.col("__html_chars").alias("n_chars"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.col("keeper")).alias("kept"),
    )


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), meet AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM meet JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x AS doc_id, min(y) AS least FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(least, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_sum([q.v[i] * r.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
), t AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(quality.learnable(docs), table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, ["doc_id"], model)
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("__quality_score").alias("score"),
        (F.col("__quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__line_n").alias("n_lines"),
        F.col("__line_dropped").alias("n_dropped"),
        sha256(F.col("__line_kept")).alias("kept_sha256"),
    )


OP7_SQL = """
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, f.last IS NOT NULL AND k.doc_id <> f.last AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.learnable(docs))
    out = language_id.identify(docs, ["doc_id"], model)
    return out.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__lang_score").alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__lic_words").alias("n_words"),
        F.col("__lic_base").alias("n_base"),
        F.col("__lic_first").alias("first_word"),
        F.col("__lic_last").alias("last_word"),
        F.col("__lic_base_labels").alias("base_labels"),
        F.col("__lic_labels").alias("labels"),
        F.col("__lic_score").alias("score"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_total").alias("source_size"),
        F.round("__mix_target", 6).alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
        F.col("__mix_copies").alias("copies"),
    )


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(text, '')) AS digest
  FROM documents
), p AS (
  SELECT *, floor(sqrt(size::DOUBLE) * 2)::INT AS bin,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || digest), 1, 8))::BIGINT % 256 AS split FROM d
), s AS (
  SELECT key, sum(size)::BIGINT AS total, [1, 2, 3][((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY key
), f AS (
  SELECT *, total * 3.0::DOUBLE / w AS turn, sum(total) OVER () AS every, sum(w) OVER () AS w_all FROM s
), h AS (
  SELECT *, row_number() OVER (ORDER BY turn, key) AS place,
         (every * 1.0::DOUBLE - coalesce(sum(total) OVER before, 0) * 3.0::DOUBLE) / (w_all - coalesce(sum(w) OVER before, 0)) AS level
  FROM f WINDOW before AS (ORDER BY turn, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), i AS (
  SELECT *, min(place) FILTER (turn > level) OVER () AS first FROM h
), t AS (
  SELECT key, total, CASE WHEN first IS NULL OR place < first THEN total * 3.0::DOUBLE
                          ELSE max(level) FILTER (place = first) OVER () * w END AS target FROM i
), b AS (
  SELECT key, bin, count(*)::BIGINT AS n, sum(size)::BIGINT AS size, any_value(t.total) AS total, any_value(t.target) AS target,
         row_number() OVER (PARTITION BY key ORDER BY bin DESC) AS k,
         ('0x' || substr(md5('mix|' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM p JOIN t USING (key) GROUP BY key, bin
), r AS (
  SELECT key, 0::BIGINT AS k, -1 AS bin, target AS goal, total::DOUBLE AS remaining, 0.0::DOUBLE AS upto, 0.0::DOUBLE AS rate, 0.0::DOUBLE AS before
  FROM t
  UNION ALL
  SELECT key, k, bin, goal - rate * size, rest, upto + n * rate, rate, upto
  FROM (
    SELECT *, CASE WHEN mean * 100 > target
                   THEN CASE WHEN lacks > 0 AND lacks > (low + 1) * mean - goal THEN least(low + 1, 3.0::DOUBLE * n) ELSE low END / n ELSE wanted END AS rate
    FROM (
      SELECT *, goal - low * mean - 3.0::DOUBLE * rest AS lacks FROM (
        SELECT *, floor(n * wanted) AS low, size::DOUBLE / n AS mean, remaining - size AS rest FROM (
          SELECT b.*, r.goal, r.remaining, r.upto,
                 least(greatest(CASE WHEN r.remaining > 0 THEN r.goal / r.remaining WHEN b.total > 0 THEN b.target / b.total ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 3.0::DOUBLE) AS wanted
          FROM r JOIN b ON b.key = r.key AND b.k = r.k + 1))))
), x AS (
  SELECT p.*, b.total, b.target, r.rate, r.before, b.start,
         row_number() OVER (PARTITION BY p.key, p.bin ORDER BY p.split, p.size DESC, p.doc_id, p.digest)::DOUBLE AS place
  FROM p JOIN b ON b.key = p.key AND b.bin = p.bin JOIN r ON r.key = p.key AND r.bin = p.bin
), y AS (
  SELECT *, least(floor(before + rate * place + start) - floor(before + rate * (place - 1) + start), 3)::BIGINT AS copies FROM x
)
SELECT doc_id, size, total AS source_size, round(target, 6) AS target, copies * size AS taken, copies FROM y
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_html_extraction": op3_html_extraction,
    "op4_near_dedup": op4_near_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_mixing": op10_mixing,
    **conversation_queries.QUERIES,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op4_near_dedup": OP4_SQL, "op5_topk_search": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_mixing": OP10_SQL, **conversation_queries.ORACLES}
