"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, filter_audit, jaccard_join, line_rules, metric_tree, mixing, paragraphs, pii, quality, runs, token_blocks, toxicity, warc,
)

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_digest(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents
), texts AS (
  SELECT w, min(doc_id) AS rep, count(*) AS n_copies FROM words WHERE len(w) > 0 GROUP BY w
), grams AS (
  SELECT DISTINCT rep, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM texts
), sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
common AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes s ON s.rep = u JOIN sizes t ON t.rep = v
  WHERE c::DOUBLE / (s.n + t.n - c) >= 0.8
), reach AS (
  SELECT rep AS a, rep AS b FROM texts UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b
), classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT u AS rep, count(*) AS n_links FROM links GROUP BY u)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM words d LEFT JOIN texts t ON t.w = d.w LEFT JOIN classes c ON c.rep = t.rep LEFT JOIN counts k ON k.rep = t.rep
"""


@query
def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


ORACLES["op4_paragraph_dedup"] = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), numbered AS (
  SELECT doc_id, unnest(range(0, len(l))) AS paragraph, l FROM lines
), paragraphs AS (
  SELECT doc_id, paragraph::INTEGER AS paragraph, list_sum(list_transform(l[1:paragraph], lambda x: length(x) + 1)) AS before, l[paragraph + 1] AS line,
         list_filter(string_split_regex(lower(l[paragraph + 1]), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM numbered
), own AS (
  SELECT doc_id, paragraph, coalesce(before, 0)::BIGINT AS s, coalesce(before, 0)::BIGINT + length(line) AS e, w FROM paragraphs WHERE len(w) >= 30
), texts AS (
  SELECT row_number() OVER (ORDER BY min((doc_id, paragraph))) AS id, w, min((doc_id, paragraph)) AS first, count(*) AS n FROM own GROUP BY w
), grams AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM texts
), sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
common AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM common JOIN sizes s ON s.id = u JOIN sizes t ON t.id = v WHERE c::DOUBLE / (s.n + t.n - c) >= 0.8
), reach AS (
  SELECT id AS a, id AS b FROM texts UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b
), classes AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
sums AS (SELECT c, sum(n) AS occurrences, min(first) AS kept FROM classes JOIN texts USING (id) GROUP BY c HAVING sum(n) > 1),
pieces AS (
  SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \t-\r]')) AS w, generate_subscripts(string_split_regex(coalesce(text, ''), '[ \t-\r]'), 1) AS i FROM documents
), placed AS (
  SELECT *, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1)::BIGINT AS start FROM pieces
), counted AS (
  SELECT doc_id, lower(w) AS w, length(w) AS n, start, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM placed WHERE w <> ''
), said AS (
  SELECT *, coalesce((n + 3 * lag(n, 1) OVER d + 2 * lag(n, 2) OVER d) % 5 = 0, false) AS ends FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), cuts AS (
  SELECT *, coalesce(lag(ends AND NOT before) OVER (PARTITION BY doc_id ORDER BY k), false) AS begins
  FROM (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), false) AS before FROM said)
), stretches AS (
  SELECT *, sum(begins::INTEGER) OVER (PARTITION BY doc_id ORDER BY k) AS stretch FROM cuts
), numbered_words AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, stretch ORDER BY k) - 1) // 64 AS piece FROM stretches
), units AS (
  SELECT doc_id, min(k) AS k, min(start) AS s, max(start + n) AS e, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS t FROM numbered_words GROUP BY doc_id, stretch, piece
), unit_counts AS (
  SELECT t, min((doc_id, s)) AS first, count(*) AS n_all FROM units GROUP BY t HAVING min(doc_id) < max(doc_id)
), repeated_units AS (
  SELECT u.*, c.first, c.n_all, NOT (u.doc_id = c.first[1] AND u.s = c.first[2]) AS removed
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS unit FROM units) u JOIN unit_counts c USING (t)
), spans AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, removed ORDER BY unit) AS span FROM repeated_units
), passages AS (
  SELECT doc_id, 'passage' AS kind, NULL::INTEGER AS paragraph, min(s) AS start, max(e) AS "end", arg_max(first[1], n * 1000000000 - unit) AS class_doc,
         arg_max(first[2], n * 1000000000 - unit) AS class_start, arg_max(n_all, n * 1000000000 - unit) AS occurrences, removed
  FROM spans GROUP BY doc_id, removed, span HAVING sum(n) >= 20
)
SELECT o.doc_id, 'paragraph' AS kind, o.paragraph, o.s AS start, o.e AS "end", s.kept[1] AS class_doc, s.kept[2]::BIGINT AS class_start, s.occurrences,
       NOT (o.doc_id = s.kept[1] AND o.paragraph = s.kept[2]) AS removed
FROM own o JOIN texts t ON t.w = o.w JOIN classes c ON c.id = t.id JOIN sums s ON s.c = c.c
UNION ALL SELECT * FROM passages
"""


@query
def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


@query
def op3_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.largest_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


ORACLES["op3_metric_tree"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 20
"""


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), failed AS (
  SELECT doc_id, part, (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text))::INTEGER
    + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first, false)::INTEGER AS mask FROM words
), known AS (
  SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || letter FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(letter) WHERE NOT contains(o, letter)
), steps AS (
  SELECT o AS filter_order, step::INTEGER AS step, (1 << (strpos('ABCDE', o[step]) - 1)) AS bit,
         list_sum([0] || list_transform(string_split(o[1:step - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (strpos('ABCDE', c) - 1) END)) AS before
  FROM orders, range(1, 6) r(step) WHERE length(o) = 5
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (before::INTEGER | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before::INTEGER <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before::INTEGER = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM counts, steps GROUP BY part, filter_order, step
"""


@query
def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.digest(table(spark, sf_dir, "documents"))


ORACLES["op12_line_rules"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> '') AS w FROM texts
), windows AS (
  SELECT r, w[i:i + 2] AS g, i FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts
), inner_lines AS (
  SELECT r, line, regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g') AS x, len(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda w: w <> '')) AS n,
         length(regexp_replace(line, '[ \t-\r]+', '', 'g')) AS chars FROM lines
), counted AS (
  SELECT *, length(regexp_replace(x, '[^|»›•·]+', '', 'g')) AS separators, length(regexp_replace(x, '[^#*$%&|<>~^{}\\=]+', '', 'g')) AS signs,
         length(regexp_replace(x, '[^!?]+', '', 'g')) AS marks FROM inner_lines WHERE x <> ''
), judged AS (
  SELECT r, line, chars, CASE
    WHEN separators >= 3 AND 4 * separators >= n OR regexp_matches(x, '(?i)^[^a-z0-9]*(?:home|menu|search|log ?in|sign ?in|sign ?up|register|next|previous|back to top|contact us|about us|site ?map|skip to content|read more|share this|print this page)[^a-z0-9]*$') THEN 'navigation'
    WHEN length(x) <= 160 AND regexp_matches(x, '(?i)(?:all rights reserved|copyright \(c\)|©|terms of (?:use|service)|privacy policy|cookie policy|(?:uses|accept|enable) cookies|javascript is (?:disabled|required)|enable javascript|subscribe to (?:our|the) newsletter|lorem ipsum|licensed under|released under the|powered by)') THEN 'boilerplate'
    WHEN right(x, 1) NOT IN ('.', '!', '?', '…', ':', ';', '"', chr(39), '”', '’', '»', ')', ']', '。', '！', '？') OR 10 * signs >= length(x) OR marks > n THEN 'punctuation'
  END AS rule FROM counted
), per_text AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, coalesce(sum(chars) FILTER (rule IS NOT NULL), 0) AS lost, count(*) FILTER (rule = 'navigation') AS navigation,
         count(*) FILTER (rule = 'boilerplate') AS boilerplate, count(*) FILTER (rule = 'punctuation') AS punctuation FROM judged GROUP BY r
), joined AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(navigation, 0) AS lines_navigation,
         coalesce(boilerplate, 0) AS lines_boilerplate, coalesce(punctuation, 0) AS lines_punctuation
  FROM words LEFT JOIN repeated USING (r) LEFT JOIN per_text USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 30 * word_chars AS kept FROM joined
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))
