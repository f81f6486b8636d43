"""Sources, cleaning, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.operators import cleaning, sampling
from sievelab.plans import views
from sievelab.plans.corpus import SEED, Corpus, clean_messages
from sievelab.plans.oracle import sql
from sievelab.session import scratch_path
from sievelab.sources import readers, writers

LADDER_PERCENT = (10, 20, 25, 40, 50, 75, 100)


def q_read_messages(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    writers.write_messages(views.messages(spark, sf), path)
    return readers.read_messages(spark, path)


def q_read_messages_split(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    writers.write_messages(views.messages(spark, sf), path)
    return readers.read_messages_split(spark, path)


def q_read_encoding_fallback(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "encodings")
    rows = views.messages(spark, sf)
    latin = ~F.col("message").rlike(r"[^\x00-\xFF]") & (F.col("sentiment") == 2)
    parts = {"UTF-16": F.col("sentiment") == 0, "ISO-8859-1": latin}
    writers.write_messages(rows.filter(~(parts["UTF-16"] | latin)), f"{path}/utf8")
    writers.write_messages(rows.filter(parts["UTF-16"]), f"{path}/utf16", "UTF-16")
    writers.write_messages(rows.filter(latin), f"{path}/latin", "ISO-8859-1")
    return readers.read_encoding_fallback(spark, path)


def q_read_noise_pool(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "noisy")
    writers.write_messages(views.pool_irrelevant(spark, sf), f"{path}/irrelevant")
    writers.write_messages(views.pool_translated(spark, sf), f"{path}/translated")
    return readers.read_noise_pool(spark, path, ["irrelevant", "translated"])


def q_read_conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    writers.write_conflict_pairs(views.conflict_pairs(spark, sf), path)
    return cleaning.conflict_ids(readers.read_conflict_pairs(spark, path))


def q_write_clean(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "clean")
    rows = cleaning.drop_null_rows(views.messages_null(spark, sf))
    rows = cleaning.dedup_first(rows, ["message"], "row_id")
    writers.write_clean(cleaning.drop_conflicts(rows, views.conflict_pairs(spark, sf)), path)
    return readers.read_messages(spark, path)


def q_recode_label(spark, sf):
    return cleaning.recode_label(views.messages(spark, sf)).select("row_id", "sentiment")


def q_category_codes(spark, sf):
    return cleaning.category_codes(views.messages(spark, sf), "sentiment").select("row_id", "sentiment", "encoded_cat")


def q_label_encoder(spark, sf):
    sources = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    rows = Corpus(views.messages(spark, sf)).regions.select("row_id", "region").join(sources, "row_id")
    dictionary = cleaning.label_dictionary(rows.filter(F.col("region") == "train"), "source")
    return cleaning.apply_codes(rows.filter(F.col("region") != "noise"), dictionary, "source")


def q_drop_null_rows(spark, sf):
    return cleaning.drop_null_rows(views.messages_null(spark, sf))


def q_dedup_message(spark, sf):
    return cleaning.dedup_first(views.messages(spark, sf), ["message"], "row_id")


def q_dedup_id(spark, sf):
    """Messages stacked with their translated copies, which share ids: the copies must go."""
    both = views.messages(spark, sf).unionByName(
        views.pool_translated(spark, sf).withColumn("row_id", F.col("row_id") + 1_000_000_000)
    )
    unique = cleaning.dedup_first(both, ["message"], "row_id")
    return cleaning.dedup_first(unique, ["tweetid"], "row_id")


def q_drop_conflicts(spark, sf):
    rows = cleaning.dedup_first(views.messages(spark, sf), ["message"], "row_id")
    return cleaning.drop_conflicts(rows, views.conflict_pairs(spark, sf)).select("row_id", "sentiment", "tweetid")


def q_preview(spark, sf):
    rows = clean_messages(views.messages(spark, sf)).withColumn("tweetid", F.col("tweetid") * 100_000_007)
    return cleaning.preview(cleaning.tag_noise(rows.withColumn("origin", F.col("sentiment")), "mislabeled"))


def q_assign_row_id(spark, sf):
    rows = clean_messages(views.messages(spark, sf)).select("row_id", "sentiment")
    return cleaning.assign_row_id(rows, ["row_id"], SEED)


def q_xy_projection(spark, sf):
    return cleaning.xy_projection(Corpus(views.messages(spark, sf)).test())


def q_seeded_shuffle(spark, sf):
    rows = clean_messages(views.messages(spark, sf)).select("row_id", "sentiment")
    return sampling.seeded_shuffle(rows, ["row_id"], SEED)


def q_stratified_regions(spark, sf):
    return Corpus(views.messages(spark, sf)).regions.select("row_id", "sentiment", "region", "region_rank")


def q_subset_with_distribution(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    size = corpus.plan.sizes["train"] // 4
    return corpus.train(size, [0.2, 0.1, 0.6, 0.1]).select("row_id", "sentiment")


def q_capacity_check(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    n = corpus.plan.total
    wide = sampling.SplitPlan(corpus.plan.class_counts, {"train": n * 80 // 100, "test": n * 30 // 100})
    return sampling.capacity_check(corpus.clean, wide)


def q_size_ladder(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    sizes = [corpus.plan.sizes["train"] * p // 100 for p in LADDER_PERCENT]
    return sampling.size_ladder(corpus.regions, corpus.plan, sizes).select("size", "row_id", "sentiment")


def q_stratified_two_way_split(spark, sf):
    rows = clean_messages(views.messages(spark, sf)).select("row_id", "sentiment")
    return sampling.stratified_two_way_split(rows, ["row_id"], SEED, rows.count() * 30 // 100)


def q_sample_prefix(spark, sf):
    rows = views.pool_irrelevant(spark, sf)
    return sampling.sample_prefix(rows, ["row_id"], SEED, rows.count() // 3)


QUERIES = {
    "read_messages": q_read_messages,
    "read_messages_split": q_read_messages_split,
    "read_encoding_fallback": q_read_encoding_fallback,
    "read_noise_pool": q_read_noise_pool,
    "read_conflict_pairs": q_read_conflict_pairs,
    "write_clean": q_write_clean,
    "recode_label": q_recode_label,
    "category_codes": q_category_codes,
    "label_encoder": q_label_encoder,
    "drop_null_rows": q_drop_null_rows,
    "dedup_message": q_dedup_message,
    "dedup_id": q_dedup_id,
    "drop_conflicts": q_drop_conflicts,
    "preview": q_preview,
    "assign_row_id": q_assign_row_id,
    "xy_projection": q_xy_projection,
    "seeded_shuffle": q_seeded_shuffle,
    "stratified_regions": q_stratified_regions,
    "subset_with_distribution": q_subset_with_distribution,
    "capacity_check": q_capacity_check,
    "size_ladder": q_size_ladder,
    "stratified_two_way_split": q_stratified_two_way_split,
    "sample_prefix": q_sample_prefix,
}

_NAMED = "SELECT sentiment, message, tweetid FROM messages"

ORACLE = {
    "read_messages": sql("messages", _NAMED),
    "read_messages_split": sql("messages", _NAMED),
    "read_encoding_fallback": sql("messages", _NAMED),
    "read_noise_pool": sql("translated_raw", """
        SELECT 'irrelevant' AS source, text AS message, NULL::INT AS sentiment, NULL::BIGINT AS tweetid
        FROM conversations
        UNION ALL SELECT 'translated', message, sentiment, tweetid FROM translated_raw"""),
    "read_conflict_pairs": sql("conflict_pairs", """
        SELECT a AS row_id FROM conflict_pairs UNION SELECT b FROM conflict_pairs"""),
    "write_clean": sql("messages_null conflict_pairs", """
        SELECT sentiment, message, tweetid FROM (
            SELECT * FROM messages_null WHERE message IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY message ORDER BY row_id) = 1)
        WHERE row_id NOT IN (SELECT a FROM conflict_pairs UNION SELECT b FROM conflict_pairs)"""),
    "recode_label": sql("messages", "SELECT row_id, (sentiment + 1)::INT AS sentiment FROM messages"),
    "category_codes": sql("messages", """
        SELECT row_id, sentiment, (dense_rank() OVER (ORDER BY sentiment) - 1)::INT AS encoded_cat FROM messages"""),
    "label_encoder": sql("regions", """
        SELECT r.row_id, r.region, d.source, c.code FROM regions r JOIN documents d ON r.row_id = d.doc_id
        LEFT JOIN (SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS code FROM (
            SELECT DISTINCT d.source FROM regions r JOIN documents d ON r.row_id = d.doc_id
            WHERE region = 'train')) c ON d.source = c.source
        WHERE r.region <> 'noise'"""),
    "drop_null_rows": sql("messages_null", "SELECT * FROM messages_null WHERE message IS NOT NULL"),
    "dedup_message": sql("messages", """
        SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY message ORDER BY row_id) = 1"""),
    "dedup_id": sql("messages translated_raw", """
        SELECT * FROM (
            SELECT * FROM (SELECT * FROM messages UNION ALL
                           SELECT row_id + 1000000000, sentiment, message, tweetid FROM translated_raw)
            QUALIFY row_number() OVER (PARTITION BY message ORDER BY row_id) = 1)
        QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY row_id) = 1"""),
    "drop_conflicts": sql("messages conflict_pairs", """
        SELECT row_id, sentiment, tweetid FROM (
            SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY message ORDER BY row_id) = 1)
        WHERE row_id NOT IN (SELECT a FROM conflict_pairs UNION SELECT b FROM conflict_pairs)"""),
    "preview": sql("clean", """
        SELECT 1 AS noise, 'mislabeled' AS noise_text, sentiment, sentiment::VARCHAR AS origin,
               CASE WHEN tweetid > 0 THEN (tweetid * 100000007 // 100000000)::VARCHAR ELSE '-' END AS short_id,
               substr(message, 1, 30) AS short_message FROM clean"""),
    "assign_row_id": sql("clean", """
        SELECT row_id, sentiment, row_number() OVER (ORDER BY md5('522:' || row_id), row_id) - 1 AS index
        FROM clean"""),
    "xy_projection": sql("regions", "SELECT message, sentiment FROM regions WHERE region = 'test'"),
    "seeded_shuffle": sql("ranked", "SELECT row_id, sentiment, class_rank FROM ranked"),
    "stratified_regions": sql("regions", "SELECT row_id, sentiment, region, region_rank FROM regions"),
    "subset_with_distribution": sql("regions region_size", """
        SELECT row_id, sentiment FROM regions, (SELECT size // 4 AS s FROM region_size WHERE region = 'train')
        WHERE region = 'train' AND region_rank <= CASE sentiment
            WHEN 0 THEN round_even(s * 0.2::DOUBLE, 0) WHEN 1 THEN round_even(s * 0.1::DOUBLE, 0)
            WHEN 2 THEN round_even(s * 0.6::DOUBLE, 0)
            ELSE s - round_even(s * 0.2::DOUBLE, 0) - round_even(s * 0.1::DOUBLE, 0)
                   - round_even(s * 0.6::DOUBLE, 0) END"""),
    "capacity_check": sql("shares total", """
        WITH sizes AS (SELECT 0 AS ord, 'train' AS region, n * 80 // 100 AS size FROM total
                       UNION ALL SELECT 1, 'test', n * 30 // 100 FROM total
                       UNION ALL SELECT 2, 'validation', 0 UNION ALL SELECT 3, 'noise', 0),
        quota AS (SELECT ord, region, sentiment, class_n, CASE WHEN sentiment = 3
                    THEN size - sum(CASE WHEN sentiment < 3 THEN round_even(size * p, 0) ELSE 0 END)
                         OVER (PARTITION BY region)
                    ELSE round_even(size * p, 0) END::BIGINT AS need FROM sizes, shares),
        room AS (SELECT *, greatest(0, class_n - coalesce(sum(need) OVER (PARTITION BY sentiment ORDER BY ord
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS have FROM quota)
        SELECT region, sentiment, need, have, (need <= have)::INT AS ok FROM room"""),
    "size_ladder": sql("regions region_size shares", """
        WITH ladder AS (SELECT (size * pct // 100)::INT AS size FROM region_size,
                            (SELECT unnest([10, 20, 25, 40, 50, 75, 100]) AS pct) WHERE region = 'train'),
        quota AS (SELECT size, sentiment, CASE WHEN sentiment = 3
                    THEN size - sum(CASE WHEN sentiment < 3 THEN round_even(size * p, 0) ELSE 0 END)
                         OVER (PARTITION BY size)
                    ELSE round_even(size * p, 0) END AS need FROM ladder, shares)
        SELECT q.size, r.row_id, r.sentiment FROM regions r JOIN quota q ON r.sentiment = q.sentiment
        WHERE r.region = 'train' AND r.region_rank <= q.need"""),
    "stratified_two_way_split": sql("ranked shares total", """
        WITH floors AS (SELECT sentiment, (n * 30 // 100 + 1) * class_n // n AS f,
                               (n * 30 // 100 + 1) * class_n % n AS rest, n * 30 // 100 + 1 AS want
                        FROM shares, total),
        quota AS (SELECT sentiment, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, sentiment)
                                              <= want - sum(f) OVER () THEN 1 ELSE 0 END AS need FROM floors),
        chosen AS (SELECT r.row_id, r.sentiment, r.class_rank <= q.need AS inside
                   FROM ranked r JOIN quota q ON r.sentiment = q.sentiment)
        SELECT row_id, sentiment, CASE WHEN inside AND row_number() OVER (
                   PARTITION BY inside ORDER BY md5('522:' || row_id) DESC, row_id DESC) > 1 THEN 1 ELSE 2 END AS part
        FROM chosen"""),
    "sample_prefix": sql("irrelevant_raw", """
        SELECT * FROM irrelevant_raw
        QUALIFY row_number() OVER (ORDER BY md5('522:' || row_id), row_id) <= (SELECT count(*) // 3 FROM irrelevant_raw)"""),
}
