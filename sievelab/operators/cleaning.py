"""Projections, filters and row cleaning on labelled message tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievelab.operators.ranking import hash_rank

# Tag names and their ids.
NOISE_TAGS = {"none": 0, "mislabeled": 1, "irrelevant": 2, "translated": 3}
MAX_CATEGORIES = 10_000


def recode_label(df: DataFrame, column: str = "sentiment", shift: int = 1) -> DataFrame:
    """Cast the label to INT and shift it so that the smallest class is 0."""
    return df.withColumn(column, (F.col(column).cast("int") + F.lit(shift)).cast("int"))


def collect_labels(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct values of a class column; refuses a column that is not one."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(r[0] for r in rows)


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(code, value) with codes 0.. in sorted value order, at most ``MAX_CATEGORIES`` rows."""
    field = df.schema[column].dataType.simpleString()
    labels = collect_labels(df, column)
    return df.sparkSession.createDataFrame(list(enumerate(labels)), f"code int, {column} {field}")


def apply_codes(df: DataFrame, dictionary: DataFrame, column: str, code_col: str = "code", unseen: str = "null"):
    """Attach the code of each value. Unseen values give null, or an error with ``unseen='fail'``."""
    coded = df.join(F.broadcast(dictionary.withColumnRenamed("code", code_col)), column, "left")
    if unseen == "fail":
        message = F.concat(F.lit(f"unseen value in {column}: "), F.col(column).cast("string"))
        coded = coded.withColumn(
            code_col,
            F.when(F.col(code_col).isNull() & F.col(column).isNotNull(), F.raise_error(message).cast("int"))
            .otherwise(F.col(code_col)),
        )
    return coded.select(*df.columns, code_col)


def category_codes(df: DataFrame, column: str, code_col: str = "encoded_cat") -> DataFrame:
    """Dense code of each value in sorted value order; null codes as -1."""
    coded = apply_codes(df, label_dictionary(df, column), column, code_col)
    return coded.withColumn(code_col, F.coalesce(F.col(code_col), F.lit(-1)))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep, per key, the row that comes first by ``order`` (a unique column).

    Each column is taken by ``min_by``, so copies collapse on the map side before the shuffle and a
    key with very many copies costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    aggs = [F.min_by(c, order).alias(c) for c in rest]
    if order not in keys:
        aggs.append(F.min(order).alias(order))
    return df.groupBy(*keys).agg(*aggs).select(*df.columns)


def conflict_ids(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Distinct ids named on either side of a conflicting pair."""
    return pairs.select(F.explode(F.array(left, right)).alias("row_id")).distinct()


def drop_conflicts(df: DataFrame, pairs: DataFrame, key: str = "row_id") -> DataFrame:
    """Remove both rows of every pair; ids that are already gone are ignored."""
    return df.join(conflict_ids(pairs).withColumnRenamed("row_id", key), key, "left_anti")


def noise_id(tag: Column | str) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in NOISE_TAGS.items() for x in pair])
    return mapping[F.col(tag) if isinstance(tag, str) else tag]


def noise_text(noise: Column | str) -> Column:
    """Tag of an id; an unknown id gives the first tag."""
    mapping = F.create_map(*[F.lit(x) for name, i in NOISE_TAGS.items() for x in (i, name)])
    return F.coalesce(mapping[F.col(noise) if isinstance(noise, str) else noise], F.lit("none"))


def tag_noise(df: DataFrame, tag: str | None = None) -> DataFrame:
    if tag is not None:
        df = df.withColumn("noise_text", F.lit(tag))
    return df.withColumn("noise", noise_id("noise_text"))


def select_noisy(df: DataFrame) -> DataFrame:
    return df.filter(F.col("noise") != 0)


def preview(df: DataFrame, id_divisor: int = 100_000_000, width: int = 30) -> DataFrame:
    """Short form of each row for reading: id without its low digits, first characters, true label."""
    origin = F.col("origin").cast("int").cast("string") if "origin" in df.columns else F.lit(None)
    return df.select(
        "noise",
        "noise_text",
        "sentiment",
        F.coalesce(origin, F.lit("-")).alias("origin"),
        F.when(F.col("tweetid") > 0, F.expr(f"string(tweetid div {id_divisor})")).otherwise("-").alias("short_id"),
        F.substring("message", 1, width).alias("short_message"),
    )


def assign_row_id(df: DataFrame, ids: Sequence[str], seed: int, column: str = "index") -> DataFrame:
    """Fresh ids 0..n-1 in the seeded random order."""
    return hash_rank(df, ids, seed, rank_col=column).withColumn(column, F.col(column) - 1)


def xy_projection(df: DataFrame) -> DataFrame:
    return df.select("message", "sentiment")
