from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievelab.llm.common import table
from sievelab.llm.q_bpe import tokenizer_path
from sievelab.llm.token_file import read_checksums, token_file_path, write_token_file

END_ID = 2


def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file_path(spark)
    write_token_file(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, path)
    return read_checksums(spark, path)


QUERIES = {"op1_token_file": token_file}
ORACLE: dict[str, str] = {}
