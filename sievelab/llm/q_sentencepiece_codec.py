from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.common import table
from sievelab.llm.q_bpe import tokenizer_path
from sievelab.llm.sentencepiece_codec import encode


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """covered_bytes: bytes of the original text that the spans of the pieces cover."""
    coded = encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), spans=False, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("covered").alias("covered_bytes"),
    )


QUERIES = {"op13_sentencepiece_codec": sentencepiece_codec}
ORACLE: dict[str, str] = {}
