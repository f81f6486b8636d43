from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.common import table
from sievelab.llm.license_scan import scan


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files ``source/lang/doc_id.txt``; one of at most two lines is taken for a licence file
    of its directory, ``source/lang/LICENSE.doc_id``."""
    short = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= 2
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    number = F.regexp_extract("path", r"(\d+)(?:\.txt)?$", 1).cast("long")
    return scan(files).select(number.alias("doc_id"), "path", "own_license", "own_score", "license", "inherited_from")


QUERIES = {"op6_license_scan": license_scan}
ORACLE: dict[str, str] = {}
