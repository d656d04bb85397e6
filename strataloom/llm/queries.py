"""The corpus operators as registered queries, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontaminate
from .language_model import op7_lm_score
from .mixing import op5_mix_sources
from .quality import op6_quality_rules
from .repeats import op8_repeated_spans
from .simhash import op10_simhash
from .token_counts import op2_token_counts
from .token_files import op3_token_files
from .toxicity import op4_toxicity
from .warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_token_files": op3_token_files,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_lm_score": op7_lm_score,
    "op8_repeated_spans": op8_repeated_spans,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
}

OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (SELECT r, m, i, item_id FROM dw JOIN bw USING (m, g)
), words AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, m, i FROM hit)) GROUP BY r
), items AS (SELECT r, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS l FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP5_SQL = r"""
WITH narrow AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM narrow GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM totals
), limited AS (SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / w AS lw FROM weighted
), levels AS (
  SELECT *, greatest(sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(lim) OVER o, 0.0), 0.0) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0.0)) AS lev
  FROM limited WINDOW o AS (ORDER BY lw, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (SELECT source, source_size, least(lim, w * max(lev) OVER ()) AS target FROM levels
), shape AS (SELECT greatest(1, count(*) // 100000) AS m FROM narrow
), cells AS (SELECT CAST(1 << greatest(6, CASE WHEN m > 1 THEN length(bin(m - 1)) ELSE 0 END + 1) AS BIGINT) AS n FROM shape
), keyed AS (
  SELECT k.*, length(bin(size)) AS lv, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7))::BIGINT % c.n AS part FROM narrow k, cells c
), placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lv, part, size, doc_id) AS pos FROM keyed
), rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce(p.source, '')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS off
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * greatest(0, least(floor(pos * rate + off) - floor((pos - 1) * rate + off), 3)) AS BIGINT) AS taken
FROM rated
"""

OP6_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), d AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), win AS (
  SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cover AS (SELECT r, count(DISTINCT i + o) AS n FROM hits, (VALUES (0), (1), (2)) v(o) GROUP BY r
), s AS (
  SELECT doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(lines) AS n_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cover USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 4 * len(regexp_extract_all(text, '[!?]')) > n_words
    OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) < 6 * n_words
    OR 100 * len(list_distinct(words)) < 5 * least(n_words, 2000)
    OR 10 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 6 * length(regexp_replace(text, '[^\p{L}]', '', 'g'))) AS kept
FROM b
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op5_mix_sources": OP5_SQL, "op6_quality_rules": OP6_SQL}
