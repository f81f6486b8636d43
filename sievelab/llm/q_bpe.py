from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.bpe import encode
from sievelab.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    coded = encode(table(spark, sf_dir, "documents"), path, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_bpe_codec": bpe_codec}
ORACLE: dict[str, str] = {}
