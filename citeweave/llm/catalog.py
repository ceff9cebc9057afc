"""The queries of the training-data operators and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import quality
from citeweave.llm.bpe import op3_bpe
from citeweave.llm.html import op8_html
from citeweave.llm.neighbours import op5_nearest
from citeweave.llm.packing import op9_packing
from citeweave.llm.passages import op6_passages
from citeweave.llm.quality import op1_quality_rules
from citeweave.llm.secrets import op7_secret_scan
from citeweave.llm.simhash import op4_simhash
from citeweave.llm.suffixes import op2_suffix_dedup
from citeweave.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_bpe, op4_simhash, op5_nearest, op6_passages, op7_secret_scan, op8_html, op9_packing, op10_toxicity)}


#: op2 over every 50-byte string, as hexadecimal text.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE doc_id > low),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
p AS (SELECT doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r JOIN n USING (doc_id)),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS body, max(b) AS past, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(concat(coalesce(body, ''), substr(h, 2 * coalesce(past, 0) + 1)))) AS kept_sha256
FROM n LEFT JOIN k ON k.doc_id = n.doc_id
"""


_TOP = ", ".join(f"({n}, {x}::DOUBLE)" for n, x in quality.TOP.items())
_DUPLICATED = ", ".join(f"({n}, {x}::DOUBLE)" for n, x in quality.DUPLICATED.items())
#: op1: words, lines and every n-gram as rows.
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
li AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
l AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup, sum(n)::BIGINT AS n_lines, sum((n - 1) * length(line))::BIGINT AS dup_chars, sum(n * length(line))::BIGINT AS line_chars FROM li GROUP BY doc_id),
g AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, ws FROM d, (SELECT unnest(range(2, 11)) AS k) WHERE len(ws) >= k),
h AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM g),
w AS (SELECT doc_id, k, i, length(gram) - k + 1 AS chars, count(*) OVER (PARTITION BY doc_id, k, gram) AS n, row_number() OVER (PARTITION BY doc_id, k, gram ORDER BY i) AS nth FROM h),
rw AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM w WHERE k = 3 AND n > 1) GROUP BY doc_id),
tp AS (SELECT doc_id, max((n * chars)::DOUBLE / word_chars / x) AS top FROM w JOIN (VALUES {_TOP}) v(k, x) USING (k) JOIN b USING (doc_id) WHERE n > 1 GROUP BY doc_id),
cv AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS j FROM w WHERE k > 4 AND nth > 1),
du AS (SELECT doc_id, max(inside::DOUBLE / word_chars / x) AS dup FROM (SELECT doc_id, k, sum(length(ws[j])) AS inside FROM cv JOIN d USING (doc_id) GROUP BY doc_id, k) JOIN (VALUES {_DUPLICATED}) v(k, x) USING (k) JOIN b USING (doc_id) GROUP BY doc_id),
m AS (SELECT b.*, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n_repeat, 0) > 50 * n_words AS base_failed,
  CASE WHEN n_dup >= {quality.LEAST_LINES} THEN n_dup::DOUBLE / n_lines ELSE 0 END AS dup_line_share, coalesce(dup_chars::DOUBLE / line_chars, 0) AS dup_line_chars, coalesce(top, 0) AS top_share, coalesce(dup, 0) AS dup_share
  FROM b LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN tp USING (doc_id) LEFT JOIN du USING (doc_id))
SELECT *, NOT base_failed AND top_share <= 1 AND dup_share <= 1 AND dup_line_share <= {quality.LINES} AND dup_line_chars <= {quality.LINE_CHARS} AS kept FROM m
"""


def oracle_sql() -> dict[str, str]:
    """The other operators' models, hashes, tokenizers and parsers can't be stated in SQL; tests/llm holds plain versions."""
    return {"op1_quality_rules": QUALITY_SQL, "op2_suffix_dedup": SUFFIX_SQL}
