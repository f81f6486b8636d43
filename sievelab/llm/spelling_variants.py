"""Spelling variants: words of one edit from each other, found by pivotal bigrams, and the form that each stands for.

* Bigrams have one order, the rarest first. A word's gram prefix holds its first three bigrams in that order and all
  that are as rare as the third. Among them, two that do not overlap are its pivots, chosen by dynamic programming over
  their places so that their frequencies add up to the least.
* One edit destroys at most one of two disjoint bigrams. So, of two near words, the one whose prefix ends earlier in the
  order has a pivot that the other has in its prefix, moved by at most one place.
* A pivot that survives splits the word: the edit is either behind it, and all up to the pivot's end is equal, or before
  it, and all from its start is equal. Of the side with the edit, one half is equal. The join key is the pivot with the
  equal side, the length of the other side and its equal half; lengths of the other word may differ by one. So a key
  has few words even for frequent bigrams, and the join compares only these, by edit distance, in its condition.
* A word's form is its most frequent near word if that is ``ratio`` times as frequent; roots follow by pointer
  doubling, each round written to the shared folder. Chains are short, for counts grow by ``ratio`` at each step.

The table of bigram frequencies has at most (letters of the alphabet)**2 rows and travels with the tasks. All joins are by
sorted shuffles: Spark takes a side with many keys a word, or words stored by dictionary, for smaller than it is and would broadcast it.

Defined results: null texts have no words; null ids count as empty in the key of ``changed``; repeated rows count each;
an empty table gives an empty table; ties go to the word that is first in code-point order; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import drop_path, pick, spread, written

RUN = "[A-Za-zÀ-ÿ]+"
NOT_RUN = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 2
EDITS = 1
#: Words must be long enough for ``GRAM * EDITS + 1`` bigrams, so that two of them are disjoint.
SHORTEST = GRAM * (EDITS + 1)


def corpus_words(
    docs: DataFrame,
    changed: Callable[[Column, Column], Column] | None = None,
    shortest: int = 6,
    least: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n: runs of letters with A-Z in lower case, of at least ``shortest`` code points, met ``least`` times or more.

    ``changed`` makes the counted word of the id (as text) and the run; it may shorten it.
    """
    rows = spread(pick(docs, id=F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text=text_col), "id")
    long_runs = F.filter(F.split("text", NOT_RUN), lambda w: F.length(w) >= shortest)
    runs = rows.select("id", F.explode(long_runs).alias("run"))
    # Spark's lower-casing would change letters beyond A-Z too
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[^A-Za-z]"), F.translate("run", UPPER, LOWER)).otherwise(F.lower("run")))
    word = changed(F.col("id"), F.col("run")) if changed else F.col("run")
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= least) & (F.length("word") >= shortest))


def gram_prefix(word: str, frequency: dict[str, int]) -> tuple[list[tuple[int, int]], tuple[int, str]]:
    """(place, frequency) of the prefix's bigrams by place, and the last one's rank in the order."""
    grams = [(frequency[word[i : i + GRAM]], word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1)]
    last = sorted(grams)[GRAM * EDITS][:2]
    return [(i, n) for n, gram, i in grams if (n, gram) <= last], last


def pivots(prefix: list[tuple[int, int]], picks: int = EDITS + 1) -> list[int]:
    """Places of ``picks`` disjoint bigrams with the least sum of frequencies; of equal sums the first places."""
    # best[i][j]: the cheapest choice of j disjoint ones among the first i
    best: list[list] = [[(0, [])] + [None] * picks]
    for i, (place, n) in enumerate(prefix):
        free = sum(p <= place - GRAM for p, _ in prefix[:i])
        row = list(best[-1])
        for j in range(1, picks + 1):
            before = best[free][j - 1]
            if before is not None:
                row[j] = min([(before[0] + n, [*before[1], place]), *([row[j]] if row[j] else [])])
        best.append(row)
    return best[-1][picks][1]


CHOSEN = "word string, n long, last long, pivots array<int>, prefix array<int>"


def _chosen(words: DataFrame) -> DataFrame:
    """Each word with the places of its pivots and of its prefix, and the rank at which its prefix ends."""
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    # at most the square of the alphabet
    frequency = {r.gram: r.n for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in frequency.items()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            last, chosen, prefix = [], [], []
            for word in batch.column("word").to_pylist():
                near, end = gram_prefix(word, frequency)
                last.append(rank[end[1]])
                chosen.append(pivots(near))
                prefix.append([i for i, _ in near])
            columns = [batch.column("word"), batch.column("n"), pa.array(last, pa.int64()), pa.array(chosen, ints), pa.array(prefix, ints)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "last", "pivots", "prefix"])

    return words.mapInArrow(run, CHOSEN)


def _keys(place: Column, longer: int) -> Column:
    """Keys of the word around a bigram at ``place``, for words whose side with the edit has ``longer`` more letters."""
    word, keys = F.col("word"), []
    sides = (
        ("behind", F.substring(word, F.lit(1), place + GRAM), F.substring(word, place + GRAM + 1, F.length(word))),
        ("before", F.substring(word, place + 1, F.length(word)), F.substring(word, F.lit(1), place)),
    )
    for side, same, rest in sides:
        size = F.length(rest) + longer
        half = F.floor(size / 2).cast("int")
        keys.append(F.xxhash64(F.lit(side), same, size, F.lit("first"), F.substring(rest, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(side), same, size, F.lit("second"), F.right(rest, size - half)))
    return F.array(*keys)


def _found(chosen: DataFrame) -> DataFrame:
    """x, y and their counts: words of one edit from each other, as often as they have keys in common."""
    every = lambda places, longer: F.flatten(F.transform(places, lambda p: _keys(p, longer)))
    asks = chosen.select(F.col("word").alias("x"), F.col("n").alias("x_n"), F.col("last").alias("x_last"), F.explode(every("pivots", 0)).alias("key"))
    index = chosen.select(
        F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"),
        F.explode(F.array_distinct(F.concat(*[every("prefix", d) for d in range(-EDITS, EDITS + 1)]))).alias("key"),
    )
    one_edit = (F.col("x_last") <= F.col("y_last")) & (F.levenshtein("x", "y", EDITS) == EDITS)
    return asks.hint("merge").join(index.withColumnRenamed("key", "y_key"), (F.col("key") == F.col("y_key")) & one_edit)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: all pairs of words (a before b) that differ by exactly one edit, each once."""
    chosen, path = written(_chosen(words), "variant-words", with_path=True)
    found = _found(chosen)
    first = F.col("x") < F.col("y")
    sided = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("a", "x", "y"), ("b", "y", "x"), ("a_n", "x_n", "y_n"), ("b_n", "y_n", "x_n"))]
    pairs, _ = written(found.select(*sided).distinct(), "variant-pairs", with_path=True)
    drop_path(words.sparkSession, path)
    return pairs


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; words are distinct, with at least ``SHORTEST`` code points."""
    spark = words.sparkSession
    words, words_path = written(words.select("word", F.col("n").cast("long").alias("n")), "variant-counts", with_path=True)
    sides = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("word")).alias("near")) for a, b in ("ab", "ba")]))
    near = (
        near_pairs(words).select(sides.alias("s")).select("s.word", "s.near")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("top"))
    )
    strong = -F.col("top.less") >= ratio * F.col("n")
    forms, forms_path = written(
        words.hint("merge").join(near, "word", "left").select(
            "word", F.when(strong, F.col("top.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, -F.col("top.less")).alias("form_n"),
        ),
        "variant-forms", with_path=True,
    )
    drop_path(spark, words_path)
    roots, path = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> tuple[DataFrame, str]:
    """Last word of each chain of links, by doubling the steps until none moves."""
    spark = links.sparkSession
    links, path = written(links, "variant-roots", with_path=True)
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved, next_path = written(
            links.hint("merge").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on")),
            "variant-roots", with_path=True,
        )
        drop_path(spark, path)
        if not moved.filter("on").limit(1).count():
            return moved.select("word", "root"), next_path
        links, path = moved.select("word", "root"), next_path
