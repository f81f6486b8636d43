from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelab.llm.common import table
from sievelab.llm.quality_rules import rule_verdicts
from sievelab.llm.textstats import STOP_WORDS

CONTRACT = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
]


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(table(spark, sf_dir, "documents")).select(*CONTRACT)


SPACES = r"'[ \t\n\x0b\x0c\r]+'"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), {SPACES}), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines
  FROM documents
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         len(list_filter(words, lambda w: lower(w) IN ({STOPS}))) AS n_stop,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 10000000 AND word_chars / n_words BETWEEN 2 AND 15
       AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.3
       AND (n_words < 100 OR n_stop / n_words >= 0.01) AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""

QUERIES = {"op10_quality_rules": quality_rules}
ORACLE = {"op10_quality_rules": SQL}
