from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.common import crc_fold, table
from sievelab.llm.katz import score_texts

FOLDS, HELD_OUT = 7, 2


def katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT)


QUERIES = {"op3_katz_scores": katz_scores}
ORACLE: dict[str, str] = {}
