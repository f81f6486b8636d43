"""Views on the shared test tables that stand in for a labelled message collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.functions.hashing import hash_int
from sievelab.functions.vectors import array_sum, class_means, distances_to, scale_by
from sievelab.operators.skew import lookup_join, spread_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    sentiment = F.expr("CASE lang WHEN 'de' THEN -1 WHEN 'fr' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 END")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"),
        sentiment.cast("int").alias("sentiment"),
        F.col("text").alias("message"),
        F.col("doc_id").alias("tweetid"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages dealt out over the cores, for work on whole texts."""
    return spread_rows(messages(spark, sf), "row_id")


def messages_null(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).withColumn("message", F.when(F.col("row_id") % 17 != 0, F.col("message")))


def conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each copy of a text paired with the first one when their sources differ; linear in the rows."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    first = docs.groupBy("text").agg(
        F.min("doc_id").alias("a"), F.min_by("source", "doc_id").alias("first_source"),
        F.count(F.lit(1)).alias("copies"),
    )
    return (
        lookup_join(docs, first, "text", F.col("doc_id"), "copies")
        .filter((F.col("doc_id") > F.col("a")) & (F.col("source") != F.col("first_source")))
        .select("a", F.col("doc_id").alias("b"))
    )


def pool_irrelevant(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("row_id"), F.col("text").alias("message")
    )


def pool_translated(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its words reversed; label and id kept."""
    words = F.reverse(F.split("message", " "))
    return messages(spark, sf).withColumn("message", F.array_join(words, " "))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("sentiment"),
    )


def outlier_vectors(spark: SparkSession, sf: str) -> DataFrame:
    planted = F.col("row_id") % 25 == 0
    return vectors(spark, sf).withColumn(
        "features", F.when(planted, F.transform("features", lambda x: x * 4)).otherwise(F.col("features"))
    ).withColumn("noise", planted.cast("int"))


def separated_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumn(
        "features", F.transform("features", lambda x, i: F.when(i == F.col("sentiment"), x + 1.0).otherwise(x))
    )


def noisy_vectors(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.pmod(hash_int(522, "row_id"), F.lit(10)) == 0
    other = F.pmod(F.col("sentiment") + 1 + F.pmod(hash_int(523, "row_id"), F.lit(9)), F.lit(10)).cast("int")
    return (
        separated_vectors(spark, sf)
        .withColumn("origin", F.col("sentiment"))
        .withColumn("noise", moved.cast("int"))
        .withColumn("sentiment", F.when(moved, other).otherwise(F.col("sentiment")))
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """True label and the label of the nearest mean; wrong often enough to fill every metric cell."""
    rows = vectors(spark, sf)
    means = class_means(rows)
    nearest = F.array_position("d", F.array_min("d")) - 1
    labels = F.lit(list(means))
    return rows.withColumn("d", distances_to(list(means.values()))).select(
        "row_id", F.col("sentiment").alias("y_true"), F.get(labels, nearest.cast("int")).alias("y_pred")
    )


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, sentiment, origin, noise, probs): softmax of -8 x distance to each mean by given label."""
    rows = noisy_vectors(spark, sf)
    means = class_means(rows)
    weights = F.transform(distances_to(list(means.values())), lambda d: F.exp(-8 * d))
    return rows.withColumn("ws", weights).select(
        "row_id", "sentiment", "origin", "noise", scale_by("ws", array_sum("ws")).alias("probs")
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    """(run, epoch, loss, accuracy, val_loss, val_accuracy) with one epoch per hour of events."""
    events = table(spark, sf, "events").select("ts", "event_type", "value")
    first = events.groupBy("event_type").agg(F.min("ts").alias("t0"))
    hours = F.expr("CAST(CAST(ts - t0 AS INTERVAL HOUR) AS INT)")
    return (
        events.join(first, "event_type")
        .groupBy(F.col("event_type").alias("run"), hours.alias("epoch"))
        .agg(
            F.min("value").alias("loss"),
            F.max("value").alias("accuracy"),
            F.round(F.stddev_pop("value"), 6).alias("val_loss"),
            F.round(F.avg("value"), 6).alias("val_accuracy"),
        )
    )
