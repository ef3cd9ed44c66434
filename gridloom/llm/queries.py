"""The operators' queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import dom_model, hash_tree, importance, licenses, line_frequency, line_templates, minhash, mixing, projection, sentencepiece_model
from gridloom.llm.common import read

MODEL = "piece_bpe_32k.model"
QUALITY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_left_words", "base_failed", "kept"]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_model.encode(docs, public_tokenizers.path(MODEL)).select("doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", "parity")


def op2_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shards(read(spark, sf_dir, "documents"), 8)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(read(spark, sf_dir, "documents")).select(*QUALITY_COLUMNS)


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(line_templates.line_dedup(read(spark, sf_dir, "documents")))


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op8_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_model.extracted(read(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


def op10_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_sentencepiece, op2_hash_tree, op3_line_frequency, op4_line_templates, op5_importance, op6_minhash, op7_mixing, op8_dom_model, op9_licenses, op10_projection)
    return {f.__name__: f for f in named}


WORDS_OF = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t, {WORDS_OF.format("text")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS norm
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)
), hosts AS (
  SELECT source, count(DISTINCT text) AS docs FROM d WHERE text IS NOT NULL GROUP BY source
), often AS (
  SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE norm <> ''
  GROUP BY l.source, l.norm, h.docs HAVING count(DISTINCT l.text) >= 20 AND count(DISTINCT l.text) >= h.docs * 0.01::DOUBLE
), per AS (
  SELECT l.doc_id, count(o.norm) AS removed, sum(CASE WHEN o.norm IS NULL THEN len({WORDS_OF.format("l.line")}) ELSE 0 END) AS n_left,
         count(CASE WHEN l.norm <> '' THEN 1 END) - count(DISTINCT CASE WHEN l.norm <> '' THEN l.line END) AS dup
  FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY l.doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_lines_removed, coalesce(n_left, 0)::BIGINT AS n_left_words
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN per USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= n_words * 0.5::DOUBLE AS kept
FROM base
"""

OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * common >= 80 * (m.n + o.n - common)
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), low AS (
  SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.c, d.doc_id) AS component_id, coalesce(low.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

OP7 = rf"""
WITH k AS (
  SELECT doc_id, source, len({WORDS_OF.format("text")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM k GROUP BY source
), s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, cap / weight AS ratio,
    (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (
  SELECT *, level * weight >= cap AS filled, ceil(source_size / least(4096, greatest(64, ceil(total / 1048576.0::DOUBLE))))::BIGINT AS n_blocks FROM s2
), s4 AS (
  SELECT *, CASE WHEN filled OR source_size = 0 THEN cap ELSE (SELECT level FROM s3 WHERE NOT filled ORDER BY ratio, place LIMIT 1) * weight END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN n_blocks > 0 THEN target / source_size * n_blocks ELSE 0.0::DOUBLE END AS share FROM s4
), s6 AS (
  SELECT *, sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shares,
    coalesce(sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, max(CASE WHEN share > 0 THEN place END) OVER () AS last FROM s5
), s AS (
  SELECT place, source, source_size, target, n_blocks, below / shares AS lo, CASE WHEN place = last THEN 1.0::DOUBLE ELSE upto / shares END AS hi, round(shares)::BIGINT AS slots FROM s6
), points AS (
  SELECT j, j * 0.6180339887498949::DOUBLE - floor(j * 0.6180339887498949::DOUBLE) AS p FROM (SELECT unnest(range(1, (SELECT max(slots) FROM s) + 1)) AS j)
), plan AS (
  SELECT place, n_blocks, row_number() OVER (PARTITION BY place ORDER BY j) - 1 AS r FROM points JOIN s ON p >= lo AND p < hi
), times AS (
  SELECT place, r % n_blocks AS block, count(*) AS times FROM plan WHERE r < 2 * n_blocks GROUP BY 1, 2
), row AS (
  SELECT k.doc_id, k.size, s.place, s.n_blocks, s.source_size, (sum(k.size) OVER (PARTITION BY s.place ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size)::BIGINT AS start
  FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source WHERE k.size > 0
), piece AS (
  SELECT *, unnest(range(((start + 1) * n_blocks - 1) // source_size, ((start + size) * n_blocks - 1) // source_size + 1)) AS block FROM row
), took AS (
  SELECT p.place, p.start, sum((least(p.start + p.size, ((p.block + 1) * source_size) // n_blocks) - greatest(p.start, (p.block * source_size) // n_blocks)) * t.times)::BIGINT AS taken
  FROM piece p JOIN times t ON t.place = p.place AND t.block = p.block GROUP BY 1, 2
)
SELECT row.doc_id, row.size, s.source_size, s.target, coalesce(taken, 0)::BIGINT AS taken FROM row JOIN s ON s.place = row.place LEFT JOIN took ON took.place = row.place AND took.start = row.start
UNION ALL
SELECT k.doc_id, k.size, s.source_size, s.target, 0::BIGINT FROM k JOIN s ON k.source IS NOT DISTINCT FROM s.source WHERE k.size = 0
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT DISTINCT a AS vec_id, a AS other FROM links
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), low AS (
  SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id
), deg AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(deg.n, 0)::BIGINT AS n_links, coalesce(low.c, e.vec_id) AS component_id, coalesce(low.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN low USING (vec_id) LEFT JOIN deg USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_frequency": OP3, "op6_minhash": OP6, "op7_mixing": OP7, "op10_projection": OP10}
