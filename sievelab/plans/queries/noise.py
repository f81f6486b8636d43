"""Noise injection, noise pools and mixed training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelab.operators import cleaning, noise
from sievelab.plans import views
from sievelab.plans.corpus import SEED, Corpus
from sievelab.plans.oracle import sql

EVEN = [0.25, 0.25, 0.25, 0.25]


def full_corpus(spark, sf, irrelevant=True, translated=True) -> Corpus:
    """The corpus with all three noise sources in its pool."""
    corpus = Corpus(views.messages(spark, sf))
    if irrelevant:
        corpus.add_unlabelled("irrelevant", views.pool_irrelevant(spark, sf), EVEN)
    if translated:
        corpus.add_labelled("translated", views.pool_translated(spark, sf), 0.5)
    return corpus


def q_inject_mislabel(spark, sf):
    return Corpus(views.messages(spark, sf)).mislabeled().select("row_id", "origin", "sentiment", "noise_text")


def q_label_unlabelled_pool(spark, sf):
    return noise.label_unlabelled_pool(views.pool_irrelevant(spark, sf), EVEN).select("row_id", "sentiment")


def q_mislabel_ratio_pool(spark, sf):
    rows = cleaning.recode_label(views.pool_translated(spark, sf))
    return noise.mislabel_ratio_pool(rows, 0.5, SEED, 4).select("row_id", "origin", "sentiment")


def q_exclude_test_overlap(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    return noise.exclude_test_overlap(views.pool_translated(spark, sf), corpus.test(), SEED).select("row_id", "tweetid")


def q_clean_noise_pool(spark, sf):
    rows = views.pool_irrelevant(spark, sf)
    labelled = noise.label_unlabelled_pool(rows, EVEN)
    return noise.clean_noise_pool(labelled, "irrelevant", SEED, rows.count() // 2)


def q_union_noise_pool(spark, sf):
    return full_corpus(spark, sf).pool.select("row_id", "sentiment", "tweetid", "origin", "noise_text", "noise")


def q_noise_source_shares(spark, sf):
    shares = noise.noise_source_shares(full_corpus(spark, sf).pool)
    return shares.withColumn("share", F.round("share", 6))


def q_sample_noisy(spark, sf):
    corpus = full_corpus(spark, sf)
    pool = corpus.write_pool()
    return noise.sample_noisy(pool, pool.count() // 3, SEED).select("noise_text", "row_id", "sentiment", "noise")


def mixed(spark, sf):
    corpus = full_corpus(spark, sf)
    corpus.write_pool()
    train = corpus.plan.sizes["train"]
    return corpus.noisy_train(train // 2, train // 8)


def q_mix_noisy_train(spark, sf):
    return mixed(spark, sf).select("index", "row_id", "sentiment", "tweetid", "origin", "noise_text", "noise")


def q_select_noisy(spark, sf):
    return cleaning.select_noisy(mixed(spark, sf)).select("index", "row_id", "sentiment", "noise")


def q_noise_tag_codec(spark, sf):
    tagged = mixed(spark, sf).select("index", "noise_text")
    coded = tagged.withColumn("noise", cleaning.noise_id("noise_text"))
    return coded.withColumn("noise_text_back", cleaning.noise_text("noise"))


QUERIES = {
    "inject_mislabel": q_inject_mislabel,
    "label_unlabelled_pool": q_label_unlabelled_pool,
    "mislabel_ratio_pool": q_mislabel_ratio_pool,
    "exclude_test_overlap": q_exclude_test_overlap,
    "clean_noise_pool": q_clean_noise_pool,
    "union_noise_pool": q_union_noise_pool,
    "noise_source_shares": q_noise_source_shares,
    "sample_noisy": q_sample_noisy,
    "mix_noisy_train": q_mix_noisy_train,
    "select_noisy": q_select_noisy,
    "noise_tag_codec": q_noise_tag_codec,
}

ORACLE = {
    "inject_mislabel": sql("mislabeled", "SELECT row_id, origin, sentiment, noise_text FROM mislabeled"),
    "label_unlabelled_pool": sql("irrelevant_labelled", "SELECT row_id, sentiment FROM irrelevant_labelled"),
    "mislabel_ratio_pool": sql("translated_labelled", "SELECT row_id, origin, sentiment FROM translated_labelled"),
    "exclude_test_overlap": sql("translated_outside", "SELECT row_id, tweetid FROM translated_outside"),
    "clean_noise_pool": sql("irrelevant_capped", """
        SELECT row_id, message, sentiment, tweetid, origin, noise_text FROM irrelevant_capped"""),
    "union_noise_pool": sql("pool", "SELECT row_id, sentiment, tweetid, origin, noise_text, noise FROM pool"),
    "noise_source_shares": sql("pool", """
        SELECT noise, noise_text, round((SELECT count(*) FROM pool p WHERE p.noise = t.noise)
                                        / (SELECT count(*) FROM pool), 6) AS share
        FROM (VALUES (1, 'mislabeled'), (2, 'irrelevant'), (3, 'translated')) t(noise, noise_text)"""),
    "sample_noisy": sql("pool", """
        SELECT noise_text, row_id, sentiment, noise FROM pool
        QUALIFY row_number() OVER (ORDER BY md5('522:' || noise_text || ':' || row_id))
                <= (SELECT count(*) // 3 FROM pool)"""),
    "mix_noisy_train": sql("mixed", """
        SELECT index, row_id, sentiment, tweetid, origin, noise_text, noise FROM mixed"""),
    "select_noisy": sql("mixed", "SELECT index, row_id, sentiment, noise FROM mixed WHERE noise <> 0"),
    "noise_tag_codec": sql("mixed", """
        SELECT index, noise_text, noise, noise_text AS noise_text_back FROM mixed"""),
}
