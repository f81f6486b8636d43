"""Dictionaries, bags of words, TF-IDF and token ids.

The long form (row, term, weight) is plain joins and aggregates; the ML form is a Spark ML pipeline.
Term joins go through ``lookup_join`` because a common word occurs in a large part of all rows, or, where the rows come
as arrays, through ``block_lookup``, which moves a word once per block of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, Normalizer, StopWordsRemover,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sievelab.functions.text import TOPIC_STOP_WORDS, ngrams, normalize_text, tokenize_stoplist, tokenize_words
from sievelab.functions.text import word_pattern_tokens
from sievelab.functions.stemming import stem_tokens
from sievelab.operators.ranking import ordered_rank
from sievelab.operators.skew import lookup_join
from sievelab.operators.word_vectors import WordVectors, fit_word_vectors
from sievelab.session import release, rewritten

# Ids that are not words.
PAD, START, END, UNKNOWN = 0, 1, 2, 3
FIRST_WORD_ID = 4

#: The most tokens and rows, on average, of a block of texts that are looked up together.
BLOCK_TOKENS = 1 << 20
BLOCK_ROWS = 8192


def explode_terms(df: DataFrame, terms: Column | str, *keep: str, name: str = "term") -> DataFrame:
    """One row per element of an array expression, next to the columns to keep.

    The outer form with a filter behind it: for the plain form Spark derives a filter on the array's
    size and runs the whole expression a second time, below any shuffle.
    """
    return df.select(*keep, F.explode_outer(terms).alias(name)).filter(F.col(name).isNotNull())


def normalized_tokens(df: DataFrame, text: str = "message", stem: bool = True) -> DataFrame:
    """Adds ``tokens``: normalised, tokenised and, by default, stemmed words."""
    tokens = df.withColumn("tokens", tokenize_words(normalize_text(text)))
    return tokens.withColumn("tokens", stem_tokens("tokens")) if stem else tokens


def normalized_text(df: DataFrame, text: str = "message", stem: bool = True) -> DataFrame:
    """Adds ``normalized``: the tokens joined by blanks."""
    return normalized_tokens(df, text, stem).withColumn("normalized", F.array_join("tokens", " ")).drop("tokens")


def block_lookup(
    df: DataFrame, words: DataFrame, tokens: str, key: str, give: Callable[[pa.Table, np.ndarray, np.ndarray, pa.Table], pa.Table],
    schema: StructType | str,
) -> DataFrame:
    """Rows made by ``give`` from blocks of texts and the rows of ``words``, one per token, that the block has.

    ``give`` takes the rows of a block, for each of their tokens its row and its place in the words found (-1 if none), and
    these words. A word moves once to each block that has it, however often, and a task holds one block. ``df`` is read twice,
    so pass a written table.
    """
    size = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0))).alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    n, cores = size["rows"], df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-(size["tokens"] or 0) // BLOCK_TOKENS), -(-n // BLOCK_ROWS), min(cores, n))
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("__block")
    rows = df.select(block, *df.columns).repartition("__block")

    def own(texts: pa.Table) -> pa.Table:
        token = pc.drop_null(pc.unique(texts[tokens].combine_chunks().flatten()))
        return pa.table({"__part": np.full(len(token), texts["__block"][0].as_py(), np.int32), "token": token})

    # Both uses take all columns, so that the shuffle of the texts is made once.
    wanted = rows.groupBy("__block").applyInArrow(own, "__part int, token string")
    found = wanted.join(words, "token")

    def look_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        lists = texts[tokens].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        place = pc.index_in(lists.flatten(), value_set=known["token"].combine_chunks())
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return give(texts.drop_columns("__block"), owner, pc.fill_null(place, -1).to_numpy(), known)

    return rows.groupBy("__block").cogroup(found.groupBy("__part")).applyInArrow(look_up, schema)


def _same_keys(texts: pa.Table, key: str) -> tuple[np.ndarray, pa.Array]:
    """For each row the number of its key, and the keys."""
    coded = texts[key].combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def drop_rare_tokens(df: DataFrame, minimum: int = 2, tokens: str = "tokens", key: str = "row_id") -> DataFrame:
    """Drop tokens that occur fewer than ``minimum`` times in the corpus; rows left empty stay. ``key`` identifies a row."""
    counts = explode_terms(df, tokens, name="token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def keep(texts: pa.Table, owner: np.ndarray, place: np.ndarray, rare: pa.Table) -> pa.Table:
        words = texts[tokens].combine_chunks().flatten()
        kept = (place < 0) & pc.is_valid(words).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=texts.num_rows))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.filter(pa.array(kept)))
        return texts.set_column(texts.column_names.index(tokens), tokens, lists)

    schema = StructType([StructField(tokens, ArrayType(StringType())) if f.name == tokens else f for f in df.schema])
    return block_lookup(df, counts.filter(F.col("n") < minimum).select("token"), tokens, key, keep, schema)


def build_dictionary(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, occurrences, term_id) with ids 0.. in token order."""
    words = explode_terms(df, tokens, name="token").groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))
    return ordered_rank(words, ["token"], "term_id").withColumn("term_id", (F.col("term_id") - 1).cast("int"))


def term_counts(df: DataFrame, terms: Column | str, key: str = "row_id") -> DataFrame:
    """(key, term, n). Rows are spread by key first, so counting the terms of a row shuffles no term."""
    spread = df.select(key, F.col(terms).alias("__terms") if isinstance(terms, str) else terms.alias("__terms"))
    exploded = explode_terms(spread.repartition(key), "__terms", key)
    return exploded.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def doc2bow(df: DataFrame, dictionary: DataFrame, tokens: str = "tokens", key: str = "row_id") -> DataFrame:
    """(key, bow): sorted (term_id, n) pairs; unknown tokens are ignored, rows without any stay empty."""

    def count(texts: pa.Table, owner: np.ndarray, place: np.ndarray, known: pa.Table) -> pa.Table:
        number, keys = _same_keys(texts, key)
        ids = known["term_id"].to_numpy().astype(np.int64)
        width = int(ids.max(initial=0)) + 1
        pairs, times = np.unique(number[owner[place >= 0]] * np.int64(width) + ids[place[place >= 0]], return_counts=True)
        own, term = np.divmod(pairs, width)
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(keys)))])
        pair = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(times, pa.int32())], ["term_id", "n"])
        bags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)
        return pa.table({key: texts[key], "bow": bags.take(pa.array(number))})

    schema = df.select(key, F.lit(None).cast("array<struct<term_id:int,n:int>>").alias("bow")).schema
    return block_lookup(df.select(key, tokens), dictionary.select("token", "term_id"), tokens, key, count, schema)


def count_vectorize(
    train: DataFrame, rows: DataFrame, text: str = "message", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """(row_id, term, n) of ``rows`` over the terms that occur in ``train``.

    Without a stop list the built-in English one of Spark is taken.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    words = word_pattern_tokens(text, stop_words)
    vocabulary = explode_terms(train, words, name="token").distinct()
    taken = rewritten(rows.select("row_id", words.alias("tokens")), "words")

    def count(texts: pa.Table, owner: np.ndarray, place: np.ndarray, known: pa.Table) -> pa.Table:
        number, keys = _same_keys(texts, "row_id")
        width = max(known.num_rows, 1)
        pairs, times = np.unique(number[owner[place >= 0]] * np.int64(width) + place[place >= 0], return_counts=True)
        own, term = np.divmod(pairs, width)
        return pa.table({
            "row_id": keys.take(pa.array(own)), "term": known["token"].combine_chunks().take(pa.array(term)), "n": times,
        })

    schema = StructType([rows.schema["row_id"], StructField("term", StringType()), StructField("n", LongType())])
    return block_lookup(taken, vocabulary, "tokens", "row_id", count, schema)


def document_counts(df: DataFrame, terms: Column | str) -> DataFrame:
    """(term, df): the rows that each term is in. Counted before the shuffle, so no row of terms moves."""
    own = F.array_distinct(F.col(terms) if isinstance(terms, str) else terms)
    return explode_terms(df, own).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_document_frequency(
    counts: DataFrame, rows: int, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + rows) / (1 + df)) + 1, over terms within the frequency bounds.

    ``counts`` is (term, df), or has one row per text and term.
    """
    frequency = counts if "df" in counts.columns else counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = frequency.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * rows)))
    return kept.withColumn("idf", F.log(F.lit(1.0 + rows) / (1.0 + F.col("df"))) + 1.0)


def _packed(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def _blocks_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Texts sorted by key in blocks of some ``BLOCK_TOKENS`` terms; texts of one key stay together."""
    held = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        held = own if held is None else pa.concat_tables([held, own])
        while held.num_rows:
            lengths = pc.fill_null(pc.list_value_length(held["terms"]), 0).to_numpy()
            full = np.searchsorted(np.cumsum(lengths), BLOCK_TOKENS) + 1
            starts = np.flatnonzero(np.diff(_same_keys(held, key)[0])) + 1
            at = np.searchsorted(starts, full)
            if at == len(starts):
                break
            yield held.slice(0, starts[at])
            held = held.slice(starts[at])
    if held is not None and held.num_rows:
        yield held


def _counted_blocks(df: DataFrame, terms: Column | str, key: str = "row_id") -> DataFrame:
    """(block, size, words, counts, keys), written: the terms of a block of texts, their number, and how often each text has them, packed.

    Texts move by key before they are taken apart, so no term does.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, texts in enumerate(_blocks_of(batches, key)):
            texts = texts.combine_chunks()
            row, keys = _same_keys(texts, key)
            lists = texts["terms"].combine_chunks()
            words = lists.flatten()
            known = pc.is_valid(words).to_numpy(zero_copy_only=False)
            owner = np.repeat(row, pc.fill_null(pc.list_value_length(lists), 0).to_numpy())[known]
            coded = words.filter(pa.array(known)).dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            pairs, times = np.unique(owner.astype(np.int64) * max(len(rank), 1) + rank[coded.indices.to_numpy()], return_counts=True)
            own, place = np.divmod(pairs, max(len(rank), 1))
            listed = pa.table({"n": times.astype(np.int32), "place": place.astype(np.int32)})
            per_key = pa.table({"key": keys, "terms": np.bincount(own, minlength=len(keys)).astype(np.int32)})
            columns = [_packed(pa.table({"term": coded.dictionary.take(order)})), _packed(listed), _packed(per_key)]
            sizes = [pa.array([first + number]), pa.array([len(order)])]
            yield pa.RecordBatch.from_arrays([*sizes, *[pa.array([c], pa.binary()) for c in columns]], names=["block", "size", "words", "counts", "keys"])

    moved = df.repartition(key).sortWithinPartitions(key)
    listed = moved.select(key, (F.col(terms) if isinstance(terms, str) else terms).alias("terms"))
    return rewritten(listed.mapInArrow(pack, "block long, size long, words binary, counts binary, keys binary"), "counted-blocks")


def _buckets(words: pa.Array, count: int) -> np.ndarray:
    """The bucket of each term: the same number as Spark's ``crc32``."""
    return np.array([crc32(w) for w in words.cast(pa.binary()).to_pylist()], np.int64) % count


def weigh(rows: DataFrame, terms: Column | str, idf: DataFrame, sublinear: bool = False) -> DataFrame:
    """(row_id, term, weight): tf x idf, rows of unit length; terms that ``idf``, a written table, lacks add nothing.

    Terms go to buckets by hash. A block asks each bucket for its terms there, once each, and gets their idf back in that order;
    questions, answers and the block's counts move packed.
    """
    blocks = _counted_blocks(rows, terms)
    release(rows.sparkSession)
    most = max(blocks.agg(F.sum("size")).first()[0] or 0, idf.count())
    count = max(rows.sparkSession.sparkContext.defaultParallelism, -(-most // BLOCK_TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block"), batch.column("words")):
                words = _unpacked(packed)["term"].combine_chunks()
                bucket = _buckets(words, count)
                there = np.unique(bucket)
                asked = [_packed(pa.table({"term": words.filter(pa.array(bucket == b))})) for b in there]
                columns = [pa.array(there, pa.int32()), pa.array([block.as_py()] * len(there), pa.int64()), pa.array(asked, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "words"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        words = [_unpacked(p)["term"].combine_chunks() for p in asked["words"]]
        place = pc.index_in(pa.chunked_array(words, pa.string()), value_set=known["term"].combine_chunks())
        found = np.append(known["idf"].to_numpy(), np.nan)[pc.fill_null(place, -1).to_numpy()]
        parts = np.split(found, np.cumsum([len(w) for w in words])[:-1])
        given = [_packed(pa.table({"idf": part})) for part in parts[: len(words)]]
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "idf": pa.array(given, pa.binary())})

    asked = blocks.select("block", "words").mapInArrow(ask, "bucket int, block long, words binary")
    bucket = (F.crc32(F.col("term").cast("binary")) % count).cast("int").alias("bucket")
    known = idf.select(bucket, "term", "idf")
    found = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "block long, bucket int, idf binary")

    def look_up(block: pa.Table, known: pa.Table) -> pa.Table:
        if not block.num_rows or not known.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        words, counts, keys = (_unpacked(block[c][0]) for c in ("words", "counts", "keys"))
        bucket, factor = _buckets(words["term"].combine_chunks(), count), np.empty(words.num_rows)
        for b, given in zip(known["bucket"].to_pylist(), known["idf"]):
            factor[bucket == b] = _unpacked(given)["idf"].to_numpy()
        place, n = counts["place"].to_numpy(), counts["n"].to_numpy().astype(float)
        w = (1.0 + np.log(n) if sublinear else n) * factor[place]
        met = ~np.isnan(w)
        row = np.repeat(np.arange(keys.num_rows), keys["terms"].to_numpy())[met]
        w, place = w[met], place[met]
        length = np.sqrt(np.bincount(row, w * w, keys.num_rows))
        taken = [keys["key"].combine_chunks().take(pa.array(row)), words["term"].combine_chunks().take(pa.array(place)), pa.array(w / length[row])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(taken, arrow)], schema=arrow)

    schema = StructType([rows.schema["row_id"], StructField("term", StringType()), StructField("weight", DoubleType())])
    arrow = to_arrow_schema(schema)
    return blocks.repartition("block").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(look_up, schema)


def tfidf(
    train: DataFrame, rows: DataFrame, terms: Column, sublinear: bool = False, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """TF-IDF of ``rows`` with document counts from ``train`` only."""
    idf = inverse_document_frequency(document_counts(train, terms), train.count(), min_df, max_df)
    return weigh(rows, terms, rewritten(idf, "idf"), sublinear)


@dataclass
class TermWeights:
    """Fitted TF-IDF whose vocabulary is a table (term, df, idf), whatever its size."""

    idf: DataFrame

    def transform(self, rows: DataFrame, terms: Column | str = "terms", sublinear: bool = False) -> DataFrame:
        """(row_id, term, weight) of other rows; unknown terms add nothing."""
        return weigh(rows, terms, self.idf, sublinear)

    def save(self, path: str) -> None:
        self.idf.write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermWeights:
        return TermWeights(spark.read.schema("term string, df long, idf double").parquet(path))


def fit_term_weights(train: DataFrame, terms: Column | str = "terms", min_df: int = 1) -> TermWeights:
    """Document counts of ``train``, written once so that every use of them agrees."""
    idf = inverse_document_frequency(document_counts(train, terms), train.count(), min_df)
    return TermWeights(rewritten(idf, "term-weights"))


def bigram_terms(text: str = "normalized") -> Column:
    return ngrams(word_pattern_tokens(text), 1, 2)


def encode_fixed_length(
    df: DataFrame, dictionary: DataFrame, width: int = 360, tokens: str = "tokens", key: str = "row_id"
) -> DataFrame:
    """(key, input_ids, attention_mask): start, word ids, end, padded to ``width``; longer rows are cut.

    A word outside the dictionary gets the id for unknown words.
    """
    cut = df.select(key, F.slice(tokens, 1, width - 2).alias("__t"))

    def encode(texts: pa.Table, owner: np.ndarray, place: np.ndarray, known: pa.Table) -> pa.Table:
        n = texts.num_rows
        size = np.bincount(owner, minlength=n)
        ids = np.append(known["term_id"].to_numpy() + FIRST_WORD_ID, UNKNOWN)
        filled = np.full((n, width), PAD, np.int32)
        filled[owner, 1 + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]] = ids[place]
        filled[:, 0] = START
        filled[np.arange(n), 1 + size] = END
        mask = (np.arange(width) < 2 + size[:, None]).astype(np.int32)
        ends = pa.array(np.arange(n + 1) * width, pa.int32())
        return pa.table({
            key: texts[key],
            "input_ids": pa.ListArray.from_arrays(ends, pa.array(filled.ravel())),
            "attention_mask": pa.ListArray.from_arrays(ends, pa.array(mask.ravel())),
        })

    none = F.lit(None).cast("array<int>")
    schema = df.select(key, none.alias("input_ids"), none.alias("attention_mask")).schema
    return block_lookup(cut, dictionary.select("token", "term_id"), "__t", key, encode, schema)


def topic_tokens(df: DataFrame, text: str = "message") -> DataFrame:
    return df.withColumn("tokens", tokenize_stoplist(text, TOPIC_STOP_WORDS))


def train_word2vec(
    df: DataFrame, size: int = 300, min_count: int = 1, partitions: int = 8, iterations: int = 1, seed: int = 522,
    key: str = "row_id",
) -> WordVectors:
    """Word vectors from a ``tokens`` column, as a table. ``partitions`` is the least number of parts that are trained
    apart; a larger corpus is cut into more of them."""
    rows = df.select(key, "tokens")
    if min_count > 1:
        rows = drop_rare_tokens(rows, min_count, key=key)
    return fit_word_vectors(rows, size, partitions, iterations, seed, key=key)


def fit_tfidf_pipeline(
    train: DataFrame, terms: str = "terms", vocabulary: int = 1 << 24, min_df: float = 1.0,
    max_df: float | None = None,
) -> PipelineModel:
    """ML form of ``tfidf``: counts, idf + 1 as a scaling vector, unit length; adds ``features``.

    Spark's IDF is ln((n+1)/(df+1)); the 1 that the smooth form adds goes into the scaling vector. The
    vocabulary is model state on the driver: a corpus with more terms is refused, not cut. ``min_df`` and
    ``max_df`` are shares below 1 and row counts from 1 on.
    """
    counter = CountVectorizer(inputCol=terms, outputCol="__tf", vocabSize=vocabulary, minDF=min_df)
    if max_df is not None:
        counter = counter.setMaxDF(max_df)
    counted = Pipeline(stages=[counter, IDF(inputCol="__tf", outputCol="__idf")]).fit(train)
    if len(counted.stages[0].vocabulary) >= vocabulary:
        raise ValueError(f"more than {vocabulary} terms: raise the vocabulary size or min_df")
    scaling = Vectors.dense(counted.stages[1].idf.toArray() + 1.0)
    scale = ElementwiseProduct(scalingVec=scaling, inputCol="__tf", outputCol="__w")
    unit = Normalizer(p=2.0, inputCol="__w", outputCol="features")
    return PipelineModel(stages=[counted.stages[0], scale, unit])


def sparse_id_rows(weights: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(row_id, term_ids, weights) from the long form, ids in ascending order."""
    coded = lookup_join(weights, dictionary, "term", F.col("row_id"), "occurrences")
    pairs = F.array_sort(F.collect_list(F.struct("term_id", "weight")))
    return coded.groupBy("row_id").agg(pairs.alias("p")).select(
        "row_id", F.col("p.term_id").alias("term_ids"), F.col("p.weight").alias("weights")
    )


def sparse_vectors(rows: DataFrame, width: int, features: str = "features") -> DataFrame:
    """ML vectors from ``term_ids`` and ``weights``."""
    build = F.udf(lambda ids, weights: Vectors.sparse(width, ids, weights), VectorUDT())
    return rows.withColumn(features, build("term_ids", "weights"))
