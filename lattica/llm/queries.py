"""The queries of this subpackage and, where SQL can state them, the DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import backoff, exact_dedup, mixing, pieces, quality_model, quality_rules, simhash, toxicity, training_order, warc
from lattica.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("text_key")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places, so that the order in which logarithms are summed doesn't show."""
    scored = backoff.score(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("log_prob", "mean_log_prob")})


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_quality_model": op7_quality_model,
    "op8_stupid_backoff": op8_stupid_backoff,
    "op9_simhash": op9_simhash,
    "op10_training_order": op10_training_order,
}

ORACLE_SQL = {
    "op1_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per
), filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST) AS k,
    coalesce(sum(source_size) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_size,
    coalesce(sum(weight) OVER (ORDER BY source_size / CAST(weight AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_weight,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS heavy
  FROM weighed
), levels AS (
  SELECT CAST(total - 3 * before_size AS DOUBLE) / CAST(heavy - before_weight AS DOUBLE) AS level FROM filled
  WHERE (total - 3 * before_size) * weight <= 3 * source_size * (heavy - before_weight) ORDER BY k LIMIT 1
), goal AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT level FROM levels), 0.0) * weight) AS target FROM filled
), rated AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
    CASE WHEN g.source_size = 0 THEN 0.0 ELSE least(g.target / CAST(g.source_size AS DOUBLE), 3.0) END AS rate,
    CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), counted AS (
  SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM rated
)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM counted
""",
    "op4_exact_dedup": r"""
WITH base AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), placed AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id ASC NULLS LAST) AS place,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id ASC NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM base
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM placed
""",
    "op5_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), lines AS (
  SELECT row, source, text, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, length(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT row, source, text, unnest(string_split(text, chr(10))) AS raw FROM docs) WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT row, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY row
), pos AS (
  SELECT row, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs
), grams AS (
  SELECT row, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g, lead(w, 7) OVER o AS last FROM pos WINDOW o AS (PARTITION BY row ORDER BY i)
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams WHERE last IS NOT NULL
), repeats AS (
  SELECT row, count(DISTINCT j) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM windows WHERE n > 1) GROUP BY row
), base AS (
  SELECT d.row, d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN dups USING (row) LEFT JOIN repeats USING (row)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM docs GROUP BY source
), above AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.line, h.host_docs HAVING count(DISTINCT l.text) > 50 AND count(DISTINCT l.text) > 0.01 * h.host_docs
), removed AS (
  SELECT l.row, sum(l.chars) AS removed_chars FROM lines l JOIN above a ON l.source IS NOT DISTINCT FROM a.source AND l.line = a.line GROUP BY l.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CASE WHEN base_failed THEN 0 ELSE CAST(coalesce(removed_chars, 0) AS BIGINT) END AS removed_chars, base_failed,
  NOT base_failed AND word_chars - coalesce(removed_chars, 0) >= 0.2 * word_chars AS kept
FROM failed LEFT JOIN removed USING (row)
""",
    "op6_warc": r"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN least END AS refers_to
FROM base
""",
    "op8_stupid_backoff": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), pos AS (
  SELECT row, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs
), grams AS (
  SELECT row, i, w, lag(w) OVER (PARTITION BY row ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY row ORDER BY i) AS u FROM pos
), others AS (
  SELECT row, i, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY row, w) AS c1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY row, v, w) ELSE 0 END AS c2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY row, u, v, w) ELSE 0 END AS c3
  FROM grams
), context AS (
  SELECT *, lag(c1) OVER (PARTITION BY row ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY row ORDER BY i) AS b2, count(*) OVER () - count(*) OVER (PARTITION BY row) AS rest FROM others
), scored AS (
  SELECT row, least(i, 3) AS top, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 ELSE 1 END AS used,
    CASE WHEN c3 > 0 THEN ln(c3 / b2) WHEN c2 > 0 THEN ln(c2 / b1) WHEN c1 > 0 THEN ln(c1 / rest) ELSE ln(1 / (rest + 1)) END AS score
  FROM context
), summed AS (
  SELECT row, count(*) AS n, sum(score + (top - used) * ln(0.4)) AS log_prob, count(*) FILTER (WHERE used < top) AS n_backoff FROM scored GROUP BY row
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(log_prob, 0.0), 6) AS log_prob, round(log_prob / n, 6) AS mean_log_prob, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff FROM docs LEFT JOIN summed USING (row)
""",
}
