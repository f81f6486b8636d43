from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.common import table
from sievelab.llm.html_extract import extract


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


QUERIES = {"op2_html_extract": html_extract}
ORACLE: dict[str, str] = {}
