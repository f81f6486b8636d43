from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelab.llm.collocations import collocations
from sievelab.llm.common import table


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split CROSS JOIN (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100
), inner_phrases AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM cand))
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, m), ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, k, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN totals t ON t.lang = c.lang
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""

QUERIES = {"op12_collocations": phrase_collocations}
ORACLE = {"op12_collocations": SQL}
