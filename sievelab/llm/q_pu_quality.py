from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelab.llm.common import crc_fold, table
from sievelab.llm.pu_quality import fit, scored

FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    return crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").filter(~held_out()).select("doc_id")


def pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, positives(spark, sf_dir), ~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op5_pu_quality": pu_quality}
ORACLE: dict[str, str] = {}
