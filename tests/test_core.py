"""Ranks, joins, rounding, splits and noise on small inputs."""

import csv
import random

import pytest
from pyspark.sql import Window, functions as F

from sievelab.functions.hashing import hash_key
from sievelab.functions.stemming import stem_word
from sievelab.functions.text import ngrams, one_hot, tokenize_words
from sievelab.operators import cleaning, noise, sampling, summaries
from sievelab.operators.moments import exact_percentile
from sievelab.operators.ranking import hash_rank, ordered_rank
from sievelab.operators.skew import lookup_join
from sievelab.plans.corpus import Corpus
from sievelab.sources import readers, writers


def skewed(spark, n=3000):
    """A third and more of the rows in class 0."""
    label = F.when(F.col("row_id") % 3 < 2, 0).otherwise((F.col("row_id") % 4).cast("int"))
    return spark.range(n).select(
        F.col("id").alias("row_id"), label.alias("sentiment"),
        F.concat(F.lit("text "), F.col("id").cast("string")).alias("message"), F.col("id").alias("tweetid"),
    )


def test_hash_rank_is_row_number(spark):
    df = skewed(spark)
    window = Window.partitionBy("sentiment").orderBy(hash_key(7, "row_id"), "row_id")
    want = {r[0]: r[1] for r in df.select("row_id", F.row_number().over(window)).collect()}
    got = hash_rank(df, ["row_id"], 7, by=["sentiment"]).collect()
    assert {r["row_id"]: r["rank"] for r in got} == want
    first = hash_rank(df, ["row_id"], 7, by=["sentiment"], keep_first=10).collect()
    assert {r["row_id"]: r["rank"] for r in first} == {k: v for k, v in want.items() if v <= 10}


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_ordered_rank(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = skewed(spark).withColumn("x", F.col("row_id") % 17)
        got = {r["row_id"]: r["rank"] for r in ordered_rank(df, ["x", "row_id"]).collect()}
        ordered = sorted(range(3000), key=lambda i: (i % 17, i))
        assert [got[i] for i in ordered] == list(range(1, 3001))
        by = ordered_rank(df, ["x", "row_id"], by=["sentiment"])
        window = Window.partitionBy("sentiment").orderBy("x", "row_id")
        assert by.withColumn("w", F.row_number().over(window)).filter("w <> rank").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hot_rows", [1, 100, 1_000_000])
def test_lookup_join_with_a_hot_key(spark, hot_rows):
    fact = spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("term"))
    dim = fact.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("term <> '7'")
    dim = dim.withColumn("twice", 2 * F.col("n"))
    got = lookup_join(fact, dim, "term", F.col("id"), "n", hot_rows)
    want = fact.join(dim.drop("n"), "term")
    assert got.count() == want.count() == 4999
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_exact_percentile(spark):
    np = pytest.importorskip("numpy")
    values = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame([(i, i % 3, float(v)) for i, v in enumerate(values)], "row_id bigint, g int, v double")
    for share in (0.0, 0.1, 0.333, 0.9, 1.0):
        assert exact_percentile(df, "v", share).first()["cut"] == pytest.approx(np.percentile(values, 100 * share))
        for r in exact_percentile(df, "v", share, by=["g"]).collect():
            assert r["cut"] == pytest.approx(np.percentile(values[r["g"]::3], 100 * share))


def test_percent_rounds_like_printf(spark):
    shares = [i / n for n in (7, 8, 16, 40, 200, 400, 2000) for i in range(n + 1)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(summaries.percent_string([F.col("s")])).collect()]
    assert got == ["[%.1f%%]" % (s * 100) for s in shares]


def test_regions_are_disjoint_and_exact(spark):
    corpus = Corpus(skewed(spark).withColumn("sentiment", F.col("sentiment") - 1))
    sizes = {r["region"]: r["count"] for r in corpus.regions.groupBy("region").count().collect()}
    for region, size in corpus.plan.sizes.items():
        assert sizes[region] == size
    assert corpus.regions.select("row_id").distinct().count() == 3000
    ladder = sampling.size_ladder(corpus.regions, corpus.plan, [100, 400, 1000])
    small, large = [ladder.filter(F.col("size") == s).select("row_id") for s in (100, 400)]
    assert small.join(large, "row_id", "left_anti").count() == 0
    bad = corpus.mislabeled().filter("sentiment = origin or sentiment < 0 or sentiment > 3")
    assert bad.count() == 0


def test_capacity_errors(spark):
    with pytest.raises(sampling.CapacityError):
        sampling.SplitPlan([5, 5], {"train": 11}).check()
    full = sampling.SplitPlan([31, 121, 17, 20], {"train": 113, "test": 22, "validation": 12, "noise": 42})
    counts = full.counts()
    assert [sum(c) for c in counts.values()] == [113, 22, 12, 42]
    assert [sum(c) for c in zip(*counts.values())] == full.class_counts
    assert full.subset_quota("noise") == counts["noise"]
    plan = sampling.SplitPlan([90, 10], {"train": 50})
    with pytest.raises(sampling.CapacityError):
        plan.subset_quota("train", 51)
    with pytest.raises(sampling.CapacityError):
        plan.subset_quota("train", 40, [0.5, 0.5])
    assert plan.subset_quota("train", 10, [0.5, 0.5]) == [5, 5]
    assert sum(sampling.largest_remainder_quota(7, [3, 3, 5])) == 7


def test_two_way_split_sizes(spark):
    df = skewed(spark, 100).select("row_id", "sentiment")
    for size in (10, 33, 99, 100):
        parts = sampling.stratified_two_way_split(df, ["row_id"], 5, size).groupBy("part").count().collect()
        assert {r["part"]: r["count"] for r in parts}[1] == size
    assert sampling.stratified_two_way_split(df, ["row_id"], 5, 1).filter("part = 1").count() == 100


def test_mixed_set_holds_no_training_id_among_translated(spark):
    corpus = Corpus(skewed(spark).withColumn("sentiment", F.col("sentiment") - 1))
    pool = skewed(spark).withColumn("sentiment", F.col("sentiment") - 1).withColumn("message", F.reverse("message"))
    corpus.add_labelled("translated", pool, 1.0)
    assert corpus.pool.filter("noise_text = 'translated' and origin = sentiment").count() == 0
    shares = [r["share"] for r in noise.noise_source_shares(corpus.pool).collect()]
    assert sum(shares) == pytest.approx(1.0)
    mixed = corpus.noisy_train(500, 200)
    assert mixed.count() == 700
    train, noisy = mixed.filter("noise = 0"), mixed.filter("noise_text = 'translated'")
    assert noisy.join(train, "tweetid", "left_semi").count() == 0
    assert sorted(r["index"] for r in mixed.select("index").collect()) == list(range(700))
    with pytest.raises(sampling.CapacityError):
        noise.mix_noisy_train(corpus.train(), corpus.pool, 5000, 522)


def test_label_encoder_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",)], "v string")
    rows = spark.createDataFrame([("a",), ("c",)], "v string")
    dictionary = cleaning.label_dictionary(train, "v")
    assert {r["v"]: r["code"] for r in cleaning.apply_codes(rows, dictionary, "v").collect()} == {"a": 0, "c": None}
    with pytest.raises(Exception, match="unseen value"):
        cleaning.apply_codes(rows, dictionary, "v", unseen="fail").collect()


def test_dedup_keeps_first(spark):
    rows = [(3, "x"), (1, "x"), (2, "y"), (5, None)]
    df = spark.createDataFrame(rows, "row_id bigint, message string")
    kept = cleaning.dedup_first(cleaning.drop_null_rows(df), ["message"], "row_id")
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2]


def test_text_functions(spark):
    df = spark.createDataFrame([("i cannot “go” gonna",), ("",)], "t string")
    assert [r[0] for r in df.select(tokenize_words("t")).collect()] == [["i", "can", "not", "“", "go", "”", "gon", "na"], []]
    one = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    got = [r[0] for r in one.select(ngrams("t", 1, 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    codes = spark.createDataFrame([(1,), (9,)], "y int").select(one_hot("y", [0, 1, 2]))
    assert [r[0] for r in codes.collect()] == [[0, 1, 0], [0, 0, 0]]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("enjoy", "enjoy"), ("died", "die"), ("spied", "spi"), ("dying", "die"),
        ("relational", "relat"), ("conditional", "condit"), ("rationally", "ration"), ("vietnamization", "vietnam"),
        ("hopefulness", "hope"), ("triplicate", "triplic"), ("electrical", "electr"), ("revival", "reviv"),
        ("adjustable", "adjust"), ("adoption", "adopt"), ("communism", "commun"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("climate", "climat"), ("changing", "chang"), ("news", "news"),
        ("analogy", "analog"), ("geology", "geolog"), ("by", "by"),
    ],
)
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    texts = ['a "quoted" one', "two\nlines", " blanks ", "comma, here", "back\\slash", 'ends with "']
    df = spark.createDataFrame([(i % 4 - 1, t, i) for i, t in enumerate(texts)], readers.MESSAGE_SCHEMA)
    writers.write_clean(df, str(tmp_path / "m"))
    got = {r["tweetid"]: r["message"] for r in readers.read_messages(spark, str(tmp_path / "m")).collect()}
    assert got == dict(enumerate(texts))


def test_one_file_in_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    bits = ["a", "two\nlines", '"', ", ", "\n\n", "\r\n", " ", "é", "\n\"\n", "x" * 90, '"\n"', "\n" * 70]
    written = []
    for n in range(3):
        rows = [(i % 4 - 1, "".join(rng.choice(bits) for _ in range(rng.randrange(7))) or None, i) for i in range(n * 1000, n * 1000 + 200)]
        with open(tmp_path / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n" if n == 1 else "\n")
            w.writerows([["sentiment", "message", "tweetid"] if n < 2 else ["sentiment", "mess\nage", "tweetid"], *rows])
        written += rows
    key = lambda r: r["tweetid"]
    same = [str(tmp_path / f"{n}.csv") for n in (0, 2)]
    assert sorted(readers.read_messages(spark, same).collect(), key=key) == [r for r in written if r[2] // 1000 != 1]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (150, 4096):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert size > 150 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
            assert sorted(readers.read_messages_split(spark, str(tmp_path)).collect(), key=key) == written
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.csv").write_text("sentiment,message,tweetid\n")
    assert readers.read_messages_split(spark, str(tmp_path / "e")).count() == 0


def test_ledger_batches_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    one, two = (spark.createDataFrame([(i, 0.5)], "experiment int, micro_f1 double") for i in (1, 2))
    assert writers.write_ledger(one, path, "a/1 b")
    commit = writers._commit
    monkeypatch.setattr(writers, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("broke off")))
    with pytest.raises(RuntimeError):
        writers.write_ledger(two, path, "2")
    assert [r["experiment"] for r in writers.read_ledger(spark, path).collect()] == [1]
    monkeypatch.setattr(writers, "_commit", commit)
    assert writers.write_ledger(two, path, "2")
    assert not writers.write_ledger(two, path, "2") and not writers.write_ledger(one, path, "a/1 b")
    assert sorted((r["experiment"], r["batch"]) for r in writers.read_ledger(spark, path).collect()) == [(1, "a/1 b"), (2, "2")]


def test_encodings(spark, tmp_path):
    head = "sentiment,message,tweetid\n"
    for name, encoding in (("a", "utf-8"), ("b", "gb18030"), ("c", "latin-1"), ("d", "utf-16")):
        text = {"a": "grün", "b": "气候变化", "c": "é à", "d": "où"}[name]
        (tmp_path / f"{name}.csv").write_bytes((head + f"1,{text},5\n").encode(encoding))
    got = {r["file"][-5:]: r["encoding"] for r in readers.detect_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "UTF-8", "b.csv": "GB18030", "c.csv": "ISO-8859-1", "d.csv": "UTF-16"}
    rows = readers.read_encoding_fallback(spark, str(tmp_path)).collect()
    assert sorted(r["message"] for r in rows) == sorted(["grün", "气候变化", "é à", "où"])


def test_noise_pool_takes_plain_csv_names_only(spark, tmp_path):
    (tmp_path / "irrelevant").mkdir()
    (tmp_path / "irrelevant" / "a.csv").write_text("message\nhello\n")
    (tmp_path / "irrelevant" / "a.old.csv").write_text("message\nold\n")
    (tmp_path / "irrelevant" / "a.txt").write_text("message\nno\n")
    got = readers.read_noise_pool(spark, str(tmp_path), ["irrelevant"]).collect()
    assert [(r["source"], r["message"], r["sentiment"], r["tweetid"]) for r in got] == [("irrelevant", "hello", None, None)]


def test_noise_pool_reads_each_file_by_its_header(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, text in {
        "a": "tweetid,sentiment,message\n1,2,one\n", "b": "message,sentiment\ntwo,3\n", "c": "x,message,tweetid\nq,\"thr\nee\",4\n",
        "d d": "sentiment,message,tweetid\n0,four,5\n", "e": "\nmessage\nfive\n",
    }.items():
        (tmp_path / "s" / f"{name}.csv").write_text(text)
    (tmp_path / "t").mkdir()
    got = {tuple(r) for r in readers.read_noise_pool(spark, str(tmp_path), ["s", "t"]).collect()}
    assert got == {("s", "one", 2, 1), ("s", "two", 3, None), ("s", "thr\nee", None, 4), ("s", "four", 0, 5), ("s", "five", None, None)}


def test_same_draws_everywhere(spark):
    rows = list(range(200))
    random.Random(3).shuffle(rows)
    a = spark.createDataFrame([(i,) for i in rows], "row_id bigint").repartition(7)
    b = spark.range(200).withColumnRenamed("id", "row_id").coalesce(1)
    first, second = [
        sorted(r[0] for r in sampling.sample_prefix(df, ["row_id"], 522, 20).collect()) for df in (a, b)
    ]
    assert first == second and len(first) == 20
