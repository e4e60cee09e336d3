"""Queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from cairn.llm.decontaminate import op1_benchmark_decontamination
from cairn.llm.digest import op6_quartile_digest
from cairn.llm.language import op10_language_id
from cairn.llm.mixing import op9_source_mixing
from cairn.llm.quality import op5_quality_classifier
from cairn.llm.scoring import op8_lattice_scoring
from cairn.llm.simhash import op4_simhash_near_dedup
from cairn.llm.substrings import op2_suffix_dedup
from cairn.llm.tokens import op7_wavelet_token_shards
from cairn.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quartile_digest": op6_quartile_digest,
    "op7_wavelet_token_shards": op7_wavelet_token_shards,
    "op8_lattice_scoring": op8_lattice_scoring,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, i, l.m, array_to_string(w[i:i + l.m - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT m FROM windows) AS l
  WHERE i + l.m - 1 <= len(w)
), found AS (
  SELECT s.doc_id, s.i, s.m, k.item_id FROM starts AS s JOIN windows AS k ON s.m = k.m AND s.g = k.g
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP2 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), firsts AS (
  SELECT s, min(doc_id) AS least FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE doc_id > least
), marked AS (
  SELECT doc_id, i, coalesce(lag(i) OVER w + 50 < i, TRUE) AS opens FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marked
  ) GROUP BY doc_id, n
), edges AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM spans
), pieces AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM edges JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN pieces USING (doc_id)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight FROM s
), f AS (
  SELECT source, source_size, weight,
    CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rem,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w
), b AS (
  SELECT *, rem * weight >= CAST(4 * source_size AS DOUBLE) * rest AS bound FROM f
), t AS (
  SELECT source, source_size,
    CASE WHEN bound THEN CAST(2 * source_size AS DOUBLE) ELSE weight * (SELECT rem FROM b WHERE NOT bound ORDER BY rest DESC LIMIT 1) / ((SELECT max(rest) FROM b WHERE NOT bound) * 2) END AS target
  FROM b
), q AS (
  SELECT d.doc_id, d.size, d.turn, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, words / target AS finish FROM q
), a AS (
  SELECT doc_id, size, turn, finish AS finishes_at FROM e
  UNION ALL
  SELECT doc_id, size, turn, (words + source_size) / target FROM e
), c AS (
  SELECT *, sum(size) OVER (ORDER BY finishes_at, turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM a
), k AS (
  SELECT doc_id, sum(size) AS taken FROM c WHERE upto <= (SELECT 3 * sum(size) // 2 FROM d) GROUP BY doc_id
)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken, e.finish
FROM e LEFT JOIN k ON e.doc_id = k.doc_id
"""

ORACLE = {
    "op1_benchmark_decontamination": _OP1,
    "op2_suffix_dedup": _OP2,
    "op9_source_mixing": _OP9,
}
