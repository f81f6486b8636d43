from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelab.llm.common import table
from sievelab.llm.spelling_variants import corpus_words, group_variants

#: One run in so many loses a letter.
MISPRINTS = 199


def misprinted(doc_id: Column, run: Column) -> Column:
    """The run without the code point that its checksum names, where the checksum asks for it."""
    crc = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (crc % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(crc % MISPRINTS == 0, shorter).otherwise(run)


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(corpus_words(table(spark, sf_dir, "documents"), misprinted))


QUERIES = {"op11_spelling_variants": spelling_variants}
ORACLE: dict[str, str] = {}
