"""Counts, shares and one-table summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def value_counts(df: DataFrame, column: str = "sentiment") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, column: str, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Share of each listed label among all rows, 0.0 where it does not occur; one pass, no join."""
    shares = [F.avg((F.col(column).eqNullSafe(F.lit(v))).cast("double")).alias(f"__s{i}") for i, v in enumerate(labels)]
    stack = ", ".join(f"{v}, __s{i}" for i, v in enumerate(labels))
    grouped = df.groupBy(*by).agg(*shares) if by else df.agg(*shares)
    return grouped.selectExpr(*by, f"stack({len(labels)}, {stack}) as ({column}, share)")


def _one_decimal(value: Column) -> Column:
    """Non-negative number with one decimal, rounded on its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal form half up, which differs on ties. The error of the
    product by ten is found from the two halves of the number, both of which ten multiplies exactly.
    """
    scaled = value * 10
    low = F.floor(scaled)
    rest = scaled - low
    split = value * 134217729.0
    high = split - (split - value)
    error = (high * 10 - scaled) + (value - high) * 10
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 == 1))))
    tenths = low + up.cast("bigint")
    return F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)


def percent_string(shares: Sequence[Column]) -> Column:
    """``[9.1%, 17.6%]``"""
    parts = [F.concat(_one_decimal(s * 100), F.lit("%")) for s in shares]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def distribution_string(df: DataFrame, column: str, labels: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    shares = [F.avg((F.col(column).eqNullSafe(F.lit(v))).cast("double")) for v in labels]
    text = percent_string(shares).alias("distribution")
    return df.groupBy(*by).agg(text) if by else df.agg(text)


def dataset_summary(
    regions: DataFrame, pool: DataFrame, labels: Sequence[int], raw: DataFrame | None = None
) -> DataFrame:
    """(section, item, value): sizes of the raw and the clean set and all regions, label and source shares."""
    from sievelab.operators.noise import noise_source_shares

    region_names = ["train", "test", "validation"]
    sizes = [F.sum(F.coalesce((F.col("region") == r).cast("bigint"), F.lit(0))) for r in region_names]
    shares = [F.avg((F.col("sentiment") == v).cast("double")) for v in labels]
    items = [("size", "total", F.count(F.lit(1)))]
    items += [("size", r, s) for r, s in zip(region_names, sizes)]
    items += [("label_share", str(v), s) for v, s in zip(labels, shares)]
    wide = regions.agg(*[c.cast("double").alias(f"__v{i}") for i, (_, _, c) in enumerate(items)])
    stack = ", ".join(f"'{section}', '{item}', __v{i}" for i, (section, item, _) in enumerate(items))
    summary = wide.selectExpr(f"stack({len(items)}, {stack}) as (section, item, value)")
    pool_size = pool.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("size").alias("section"), F.lit("noise_pool").alias("item"), "value"
    )
    sources = noise_source_shares(pool).select(
        F.lit("source_share").alias("section"), F.col("noise_text").alias("item"), F.col("share").alias("value")
    )
    summary = summary.unionByName(pool_size).unionByName(sources)
    if raw is not None:
        raw_size = raw.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("size").alias("section"), F.lit("raw").alias("item"), "value"
        )
        summary = summary.unionByName(raw_size)
    return summary


def detector_quality(flags: DataFrame, flag: str = "markasnoise", noise: str = "noise") -> DataFrame:
    """Flagged rows against truly noisy rows: the four counts, precision and recall (0/0 gives 0)."""
    bad, hit = F.col(noise) != 0, F.col(flag) == 1
    counts = flags.agg(
        F.sum((bad & hit).cast("bigint")).alias("tp"),
        F.sum((~bad & hit).cast("bigint")).alias("fp"),
        F.sum((bad & ~hit).cast("bigint")).alias("fn"),
        F.sum((~bad & ~hit).cast("bigint")).alias("tn"),
    )
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"),
    )


def outlier_counts(flags: DataFrame, by: Sequence[str] = (), flag: str = "markasnoise") -> DataFrame:
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(flag).cast("bigint")).alias("flagged"),
        F.avg(F.col(flag).cast("double")).alias("share"),
    )


def max_token_length(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    return tokens.agg(F.max(F.size(column)).alias("max_tokens"))
