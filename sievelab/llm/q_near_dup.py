from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelab.llm.common import table
from sievelab.llm.near_dup import near_duplicates


def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dup": near_dup}
ORACLE: dict[str, str] = {}
