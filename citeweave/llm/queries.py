"""The queries of the training-data operators, over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_extract, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, sharding, url_filters
from ._common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.quality_digest(table(s, d, "documents"), table(s, d, "labels")),
        "op2_lm_scoring": lambda s, d: lm_scoring.score(table(s, d, "documents")),
        "op3_sharding": lambda s, d: sharding.assign_shards(table(s, d, "documents").select("doc_id", "text")),
        "op4_html_extraction": lambda s, d: html_extract.extract_pages(table(s, d, "pages").select("page_id", "url", "html")),
        "op5_nearest_neighbours": lambda s, d: ann.nearest(table(s, d, "embeddings")),
        "op6_ngram_join": lambda s, d: ngram_join.similar_documents(table(s, d, "documents")),
        "op7_url_filters": lambda s, d: url_filters.filter_digest(s, table(s, d, "pages")),
        "op8_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
        "op9_mixing": lambda s, d: mixing.mix_digest(table(s, d, "documents")),
        "op10_line_dedup": lambda s, d: line_dedup.line_digest(table(s, d, "documents")),
    }


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.i, t.line, translate(trim(t.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)), range(0, len(string_split(coalesce(text, ''), chr(10)))))) AS z FROM documents) x,
       LATERAL (SELECT z[1] AS line, z[2] AS i) t),
shared AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(s.k) FILTER (WHERE l.doc_id <> s.last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE s.k IS NULL OR l.doc_id = s.last), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.k = s.k
GROUP BY l.doc_id
"""


SIMILAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT x AS doc_id, x AS other FROM links UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id), s.doc_id) AS component_id FROM sets s
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": SIMILAR_SQL, "op7_url_filters": url_filters.FILTER_SQL, "op9_mixing": mixing.MIX_SQL, "op10_line_dedup": LINE_SQL}
