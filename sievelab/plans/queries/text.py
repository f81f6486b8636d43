"""Text functions, dictionaries and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelab.functions import text as tx
from sievelab.functions.vectors import l2_normalize
from sievelab.operators import features as ft
from sievelab.operators.summaries import max_token_length
from sievelab.plans import views
from sievelab.plans.corpus import Corpus
from sievelab.plans.oracle import sql
from sievelab.session import rewritten

# Parameter of the count queries: a short stop list over the four languages of the test texts.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "it", "that", "der", "die", "das", "und", "el", "la", "los", "que",
    "de", "le", "les", "des", "un", "en",
]
WIDTH = 360


def _parts(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    train = corpus.regions.filter(F.col("region") == "train").select("row_id", "message")
    both = corpus.regions.filter(F.col("region").isin("train", "test")).select("row_id", "message")
    return train, both


def q_normalize_text(spark, sf):
    return views.texts(spark, sf).select("row_id", tx.normalize_text("message").alias("normalized"))


def q_tokenize_words(spark, sf):
    tokens = views.texts(spark, sf).select("row_id", tx.tokenize_words(tx.normalize_text("message")).alias("t"))
    return tokens.select("row_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


def q_stem_tokens(spark, sf):
    return ft.normalized_text(views.texts(spark, sf)).select("row_id", "normalized")


def q_tokenize_stoplist(spark, sf):
    tokens = ft.topic_tokens(views.texts(spark, sf))
    return tokens.select("row_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def _topic_tokens(spark, sf):
    return rewritten(ft.topic_tokens(views.texts(spark, sf)).select("row_id", "tokens"), "tokens")


def q_drop_rare_tokens(spark, sf):
    tokens = ft.drop_rare_tokens(_topic_tokens(spark, sf), 2)
    return tokens.select("row_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


def q_build_dictionary(spark, sf):
    return ft.build_dictionary(ft.topic_tokens(views.texts(spark, sf))).select("token", "term_id")


def q_doc2bow(spark, sf):
    tokens = _topic_tokens(spark, sf)
    bags = ft.doc2bow(tokens, ft.build_dictionary(tokens))
    pair = F.transform("bow", lambda s: F.concat_ws(":", s["term_id"].cast("string"), s["n"].cast("string")))
    return bags.select("row_id", F.array_join(pair, " ").alias("bow"))


def q_ngrams(spark, sf):
    grams = views.texts(spark, sf).select("row_id", tx.ngrams(tx.word_pattern_tokens("message"), 1, 2).alias("g"))
    return grams.select("row_id", F.array_join("g", "|").alias("terms"), F.size("g").alias("n"))


def q_count_vectorize(spark, sf):
    train, both = _parts(spark, sf)
    return ft.count_vectorize(train, both, "message", STOP_WORDS)


def q_tfidf(spark, sf):
    train, both = _parts(spark, sf)
    weights = ft.tfidf(train, both, tx.ngrams(tx.word_pattern_tokens(tx.normalize_text("message")), 1, 2))
    return weights.withColumn("weight", F.round("weight", 6))


def q_tfidf_sublinear(spark, sf):
    train, both = _parts(spark, sf)
    weights = ft.tfidf(train, both, tx.word_pattern_tokens("message"), sublinear=True, min_df=5, max_df=0.8)
    return weights.withColumn("weight", F.round("weight", 6))


def q_one_hot(spark, sf):
    codes = tx.one_hot(F.col("sentiment") + 1, [0, 1, 2, 3])
    return views.messages(spark, sf).select("row_id", F.array_join(codes.cast("array<string>"), "").alias("code"))


def q_encode_fixed_length(spark, sf):
    corpus = Corpus(views.messages(spark, sf))
    tokens = tx.tokenize_words(tx.normalize_text("message")).alias("tokens")
    rows = rewritten(corpus.regions.select("row_id", "region", tokens), "tokens")
    dictionary = ft.build_dictionary(rows.filter(F.col("region") == "train"))
    encoded = ft.encode_fixed_length(rows, dictionary, WIDTH)
    return encoded.select(
        "row_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), ",").alias("attention_mask"),
    )


def q_max_token_length(spark, sf):
    rows = Corpus(views.messages(spark, sf)).regions.filter(F.col("region").isin("train", "validation"))
    return max_token_length(rows.select(tx.tokenize_words(tx.normalize_text("message")).alias("tokens")))


def q_train_word2vec(spark, sf):
    model = ft.train_word2vec(ft.normalized_tokens(views.texts(spark, sf)).select("row_id", "tokens"))
    return model.getVectors()


def q_l2_normalize(spark, sf):
    unit = views.vectors(spark, sf).select("row_id", F.posexplode(l2_normalize("features")).alias("pos", "x"))
    return unit.withColumn("x", F.round("x", 6))


QUERIES = {
    "normalize_text": q_normalize_text,
    "tokenize_words": q_tokenize_words,
    "stem_tokens": q_stem_tokens,
    "tokenize_stoplist": q_tokenize_stoplist,
    "drop_rare_tokens": q_drop_rare_tokens,
    "build_dictionary": q_build_dictionary,
    "doc2bow": q_doc2bow,
    "ngrams": q_ngrams,
    "count_vectorize": q_count_vectorize,
    "tfidf": q_tfidf,
    "tfidf_sublinear": q_tfidf_sublinear,
    "one_hot": q_one_hot,
    "encode_fixed_length": q_encode_fixed_length,
    "max_token_length": q_max_token_length,
    "train_word2vec": q_train_word2vec,
    "l2_normalize": q_l2_normalize,
}

_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
_PUNCT = r"""!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~"""
_NORMAL = f"translate(lower(message), '{_PUNCT}' || chr(10), repeat(' ', 33))"
_WORD = r"[\p{L}\p{N}_]{2,}"

def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WS}'), lambda t: t <> '')"


def _apart(tokens: str) -> str:
    return f"""flatten(list_transform({tokens}, lambda t: CASE t
        WHEN 'cannot' THEN ['can', 'not'] WHEN 'gimme' THEN ['gim', 'me'] WHEN 'gonna' THEN ['gon', 'na']
        WHEN 'gotta' THEN ['got', 'ta'] WHEN 'lemme' THEN ['lem', 'me'] WHEN 'wanna' THEN ['wan', 'na'] ELSE [t] END))"""


_WORDS = _apart(_split(f"regexp_replace({_NORMAL}, '([«“‘„»”’])', ' \\1 ', 'g')"))
_STOPPED = f"list_filter({_split('lower(message)')}, lambda t: t NOT IN ('for', 'a', 'of', 'the', 'and', 'to', 'in'))"
_GRAMS = """list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
                                  ELSE [] END)"""
_TOPIC = f"topic AS (SELECT row_id, {_STOPPED} AS t FROM messages)"


def _weights(tf: str, having: str = "") -> str:
    return f"""
    tf AS (SELECT region, row_id, term, count(*) AS n FROM terms GROUP BY 1, 2, 3),
    rows AS (SELECT count(*) AS r FROM regions WHERE region = 'train'),
    idf AS (SELECT term, ln((1.0::DOUBLE + any_value(r)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
            FROM tf, rows WHERE region = 'train' GROUP BY term {having}),
    w AS (SELECT row_id, term, {tf} * idf AS w FROM tf JOIN idf USING (term))
    SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w"""


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE = {
    "normalize_text": sql("messages", f"SELECT row_id, {_NORMAL} AS normalized FROM messages"),
    "tokenize_words": sql("messages", f"""
        SELECT row_id, array_to_string(t, ' ') AS tokens, len(t)::INT AS n
        FROM (SELECT row_id, {_WORDS} AS t FROM messages)"""),
    "tokenize_stoplist": sql("messages", f"""
        WITH {_TOPIC} SELECT row_id, array_to_string(t, ' ') AS tokens, len(t)::INT AS n FROM topic"""),
    "drop_rare_tokens": sql("messages", f"""
        WITH {_TOPIC},
        placed AS (SELECT row_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM topic),
        common AS (SELECT token FROM placed GROUP BY token HAVING count(*) >= 2),
        kept AS (SELECT row_id, string_agg(token, ' ' ORDER BY pos) AS tokens, count(*)::INT AS n
                 FROM placed JOIN common USING (token) GROUP BY row_id)
        SELECT t.row_id, coalesce(tokens, '') AS tokens, coalesce(n, 0)::INT AS n
        FROM topic t LEFT JOIN kept USING (row_id)"""),
    "build_dictionary": sql("messages", f"""
        WITH {_TOPIC} SELECT token, (row_number() OVER (ORDER BY token) - 1)::INT AS term_id
        FROM (SELECT DISTINCT unnest(t) AS token FROM topic)"""),
    "doc2bow": sql("messages", f"""
        WITH {_TOPIC},
        placed AS (SELECT row_id, unnest(t) AS token FROM topic),
        dictionary AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id
                       FROM (SELECT DISTINCT token FROM placed)),
        bags AS (SELECT row_id, string_agg(term_id || ':' || n, ' ' ORDER BY term_id) AS bow FROM (
                    SELECT row_id, term_id, count(*) AS n FROM placed JOIN dictionary USING (token) GROUP BY 1, 2)
                 GROUP BY row_id)
        SELECT t.row_id, coalesce(bow, '') AS bow FROM topic t LEFT JOIN bags USING (row_id)"""),
    "ngrams": sql("messages", f"""
        SELECT row_id, array_to_string(g, '|') AS terms, len(g)::INT AS n FROM (
            SELECT row_id, {_GRAMS} AS g FROM (
                SELECT row_id, regexp_extract_all(lower(message), '{_WORD}') AS t FROM messages))"""),
    "count_vectorize": sql("regions", f"""
        WITH terms AS (
            SELECT region, row_id, unnest(regexp_extract_all(lower(message), '{_WORD}')) AS term FROM regions
            WHERE region IN ('train', 'test'))
        SELECT row_id, term, count(*) AS n FROM terms
        WHERE term NOT IN ({_STOP_SQL}) AND term IN (SELECT term FROM terms WHERE region = 'train')
        GROUP BY 1, 2"""),
    "tfidf": sql("regions", f"""
        WITH words AS (SELECT region, row_id, regexp_extract_all({_NORMAL}, '{_WORD}') AS t FROM regions
                       WHERE region IN ('train', 'test')),
        terms AS (SELECT region, row_id, unnest({_GRAMS}) AS term FROM words), {_weights("n")}"""),
    "tfidf_sublinear": sql("regions", f"""
        WITH terms AS (SELECT region, row_id, unnest(regexp_extract_all(lower(message), '{_WORD}')) AS term
                       FROM regions WHERE region IN ('train', 'test')),
        {_weights("(1.0::DOUBLE + ln(n))", "HAVING count(*) >= 5 AND count(*) <= 0.8::DOUBLE * any_value(r)")}"""),
    "one_hot": sql("messages", """
        SELECT row_id, array_to_string(list_transform([0, 1, 2, 3],
               lambda v: CASE WHEN v = sentiment + 1 THEN '1' ELSE '0' END), '') AS code FROM messages"""),
    "encode_fixed_length": sql("regions", f"""
        WITH words AS (SELECT row_id, region, ({_WORDS}) AS t FROM regions),
        dictionary AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM (
            SELECT DISTINCT unnest(t) AS token FROM words WHERE region = 'train')),
        placed AS (SELECT row_id, unnest(t[1:358]) AS token, generate_subscripts(t[1:358], 1) AS pos FROM words),
        ids AS (SELECT row_id, string_agg(coalesce(id, 3), ',' ORDER BY pos) AS s, count(*) AS n
                FROM placed LEFT JOIN dictionary USING (token) GROUP BY row_id)
        SELECT w.row_id, '1,' || coalesce(s || ',', '') || '2' || repeat(',0', (358 - coalesce(n, 0))::INT) AS input_ids,
               '1' || repeat(',1', (1 + coalesce(n, 0))::INT) || repeat(',0', (358 - coalesce(n, 0))::INT) AS attention_mask
        FROM words w LEFT JOIN ids USING (row_id)"""),
    "max_token_length": sql("regions", f"""
        SELECT max(len({_WORDS}))::INT AS max_tokens FROM regions WHERE region IN ('train', 'validation')"""),
    "l2_normalize": sql("vector_long", """
        SELECT row_id, (pos - 1)::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY row_id)), 6) AS x
        FROM vector_long"""),
}
