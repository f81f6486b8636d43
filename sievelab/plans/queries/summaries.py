"""Joins, set operations, counts and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelab.operators import summaries
from sievelab.plans import views
from sievelab.plans.corpus import Corpus, clean_messages
from sievelab.plans.oracle import sql
from sievelab.plans.queries.noise import full_corpus, mixed

LABELS = [0, 1, 2, 3]


def q_union_all(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    parts = corpus.train().unionByName(corpus.test()).unionByName(corpus.mislabeled(), allowMissingColumns=True)
    return parts.select("row_id", "sentiment", "origin", "noise_text")


def q_value_counts(spark, sf):
    return summaries.value_counts(views.messages(spark, sf))


def q_distribution(spark, sf):
    shares = summaries.distribution(mixed(spark, sf), "sentiment", [0, 1, 2, 3, 4])
    return shares.withColumn("share", F.round("share", 6))


def q_distribution_string(spark, sf):
    return summaries.distribution_string(clean_messages(views.messages(spark, sf)), "sentiment", LABELS)


def q_dataset_summary(spark, sf):
    corpus = full_corpus(spark, sf)
    corpus.write_pool()
    return corpus.summary().withColumn("value", F.round("value", 6))


QUERIES = {
    "union_all": q_union_all,
    "value_counts": q_value_counts,
    "distribution": q_distribution,
    "distribution_string": q_distribution_string,
    "dataset_summary": q_dataset_summary,
}

ORACLE = {
    "union_all": sql("regions mislabeled", """
        SELECT row_id, sentiment, NULL::INT AS origin, 'none' AS noise_text FROM regions
        WHERE region IN ('train', 'test')
        UNION ALL SELECT row_id, sentiment, origin, noise_text FROM mislabeled"""),
    "value_counts": sql("messages", "SELECT sentiment, count(*) AS n FROM messages GROUP BY 1"),
    "distribution": sql("mixed", """
        SELECT s.sentiment, round((SELECT count(*) FROM mixed m WHERE m.sentiment = s.sentiment)
                                  / (SELECT count(*) FROM mixed), 6) AS share
        FROM (SELECT unnest([0, 1, 2, 3, 4])::INT AS sentiment) s"""),
    "distribution_string": sql("shares", """
        SELECT '[' || string_agg(printf('%.1f%%', p * 100), ', ' ORDER BY sentiment) || ']' AS distribution
        FROM shares"""),
    "dataset_summary": sql("regions pool messages", """
        SELECT 'size' AS section, 'total' AS item, count(*)::DOUBLE AS value FROM regions
        UNION ALL SELECT 'size', 'raw', count(*)::DOUBLE FROM messages
        UNION ALL SELECT 'size', region, count(*)::DOUBLE FROM regions
                  WHERE region IN ('train', 'test', 'validation') GROUP BY region
        UNION ALL SELECT 'size', 'noise_pool', count(*)::DOUBLE FROM pool
        UNION ALL SELECT 'label_share', sentiment::VARCHAR, round(count(*) / (SELECT count(*) FROM regions), 6)
                  FROM regions GROUP BY sentiment
        UNION ALL SELECT 'source_share', noise_text, round(count(*) / (SELECT count(*) FROM pool), 6)
                  FROM pool GROUP BY noise_text"""),
}
