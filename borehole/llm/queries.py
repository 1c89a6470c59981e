"""The operators as registered queries over whole tables, with oracle SQL where SQL has an answer."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borehole.llm import (
    bit_codes, blocks, bpe, hamming, kmeans_tree, language, line_templates, near_dedup, packing, phrase_automata,
    risk_rules, suffix_parse, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrase_automata.remove_repeated_phrases(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_parse.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(_table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_by_sign(_table(spark, sf_dir, "embeddings"))


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op11_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bit_codes.hard_negatives(_table(spark, sf_dir, "embeddings"), moved)


def op12_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = risk_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return made.withColumn("deviation", F.col("deviation").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_phrase_dedup, op3_suffix_dedup, op4_language, op5_main_text, op6_line_dedup, op7_packing,
        op8_bpe, op9_hamming, op10_kmeans_tree, op11_bit_codes, op12_risk_rules, op13_whitening, pipeline,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)
), r(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id,
       r.node = min(r.seen) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node""",
    "op2_phrase_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT t, min(doc_id) AS low FROM g GROUP BY t),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (t) WHERE low < doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
k AS (SELECT u.doc_id, count(*) AS n, count(c.i) AS gone,
             string_agg(CASE WHEN c.i IS NULL THEN word END, ' ' ORDER BY u.i) AS kept
      FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)""",
    "op3_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS t
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM b WHERE length(x) >= 100)),
f AS (SELECT t, min(doc_id) AS low FROM g GROUP BY t),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 50 THEN 0 ELSE 1 END AS fresh
      FROM g JOIN f USING (t) WHERE low < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS last FROM s),
k AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS stop,
             string_agg(substr(x, CAST(2 * last + 1 AS BIGINT), CAST(2 * (lo - last) AS BIGINT)), '' ORDER BY lo) AS kept
      FROM e JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, CAST(2 * coalesce(stop, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, list_transform(string_split_regex(v, '[ \t\n\x0B\f\r]+'),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS ts
      FROM (SELECT doc_id, pos, regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS v FROM l) WHERE v <> ''),
k AS (
  SELECT doc_id, pos, 'line ' || len(ts) || ' ' || array_to_string(ts, ' ') AS key FROM t
  UNION ALL SELECT doc_id, pos, 'head ' || len(ts) || ' ' || array_to_string(ts[1:(len(ts) + 1) // 2], ' ')
  FROM t WHERE len(ts) >= 8
  UNION ALL SELECT doc_id, pos, 'tail ' || len(ts) || ' ' || array_to_string(ts[1:2] || ts[(len(ts) + 1) // 2 + 1:], ' ')
  FROM t WHERE len(ts) >= 8),
f AS (SELECT key, min(doc_id) AS low FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT DISTINCT doc_id, pos FROM k JOIN f USING (key) WHERE low < doc_id),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped,
             coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN m USING (doc_id)""",
    "op9_hamming": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
      FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 20""",
    "op11_bit_codes": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3""",
    "op12_risk_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, {_WORDS} AS ws, string_split(text, chr(10)) AS ls FROM t
), l AS (
  SELECT r, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
  FROM (SELECT r, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
), g AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), c AS (
  SELECT r, count(DISTINCT i) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1)
  GROUP BY r
), m AS (
  SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_lines, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t JOIN w USING (r) JOIN l USING (r) LEFT JOIN c USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), y AS (
  SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)
), k(rule, level, a, b) AS (VALUES
  {", ".join(f"({rule}, {i}, {a}, {b})" for rule, ladder in enumerate((
      [(c, 0) for c in risk_rules.SYMBOL_SHARE], [(c, 0) for c in risk_rules.REPEATED_WORDS],
      [(c, 0) for c in risk_rules.REPEATED_LINES], risk_rules.WORD_LENGTH)) for i, (a, b) in enumerate(ladder))}
), hit AS (
  SELECT f.*, rule, level, CASE rule
    WHEN 0 THEN 100 * n_symbols > a * word_chars WHEN 1 THEN 100 * n_repeat_words > a * n_words
    WHEN 2 THEN 100 * n_dup_lines > a * n_lines
    ELSE 100 * word_chars < a * n_words OR 100 * word_chars > b * n_words END AS rejected
  FROM f, k
), s AS (
  SELECT stratum, rule, level, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND rejected) AS g,
         count(*) FILTER (good = 0 AND rejected) AS p
  FROM hit JOIN y USING (doc_id) WHERE NOT base_failed GROUP BY ALL HAVING count(*) FILTER (good = 1) > 0
), chosen AS (
  SELECT stratum, rule, max_by(level, (p - g) * 100 - level) AS level FROM s
  WHERE p > g AND g < n * {risk_rules.ALPHA / risk_rules.RULES}
    AND list_sum(list_transform(range(0, g + 1), lambda i: exp(
          lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk_rules.ALPHA / risk_rules.RULES})
          + (n - i) * ln(1 - {risk_rules.ALPHA / risk_rules.RULES}))))
      <= {risk_rules.DELTA / risk_rules.RULES} / (SELECT count(DISTINCT stratum) FROM s)
  GROUP BY ALL
), gone AS (
  SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         bool_or(rejected AND hit.level = chosen.level) AS gone
  FROM hit LEFT JOIN chosen USING (stratum, rule) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(gone, false) AS kept FROM gone""",
}
