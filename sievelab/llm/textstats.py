"""Counts of a text as Spark expressions; used by the rules and by the classifier's features.

Every count is over the whole text. Windows of words are compared by 64-bit hashes of five word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = """the of and to in is that it was for on are as with be at by this from or have an
el la los de que y en un una del las por con para se no su
le les des et une dans pour sur est qui du au pas avec il
der die das und den von zu mit sich ist im dem nicht ein eine auf für""".split()


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def _removed(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``; replacing scans bytes, translating maps characters."""
    rest = text
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return _length(text) - _length(rest)


def _once(value: Column) -> Column:
    """The value as a column that the optimizer keeps: a condition on later columns pushed below it would
    repeat the value in every lambda that reads it. A partition number is never negative, but it makes the column count as not repeatable."""
    return F.when(F.spark_partition_id() >= 0, value)


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at these ascending positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        positions,
        start,
        lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")
        ),
        lambda a: a["n"],
    )


def text_counts(df: DataFrame) -> DataFrame:
    """Adds counts to a table with a column ``text`` (no nulls) and drops the working columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop, n_distinct, n_marks
    (exclamation marks), n_bars (``|``), n_caps (words in capitals), n_runs (words equal to the one before).
    Columns that are not used later cost nothing: Catalyst prunes them.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    step = df.withColumns({"__words": _once(words_of(text)), "__lines": _once(lines)})
    step = step.withColumns(
        {
            "__hashes": _once(F.transform("__words", lambda w: F.xxhash64(w))),
            "n_words": F.size("__words").cast("long"),
            "n_stop": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "word_chars": _length(F.array_join("__words", "")),
            "n_symbols": _removed(text, SYMBOLS),
            "n_marks": _removed(text, "!"),
            "n_bars": _removed(text, "|"),
            "n_caps": F.size(F.filter("__words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long"),
        }
    )
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("__hashes") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumns(
        {
            "__windows": _once(windows),
            "n_distinct": F.size(F.array_distinct("__hashes")).cast("long"),
            "n_runs": F.aggregate(
                "__hashes",
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")),
                lambda a, h: F.struct(
                    (a["n"] + F.when(a["last"] == h, 1).otherwise(0)).alias("n"), h.alias("last")
                ),
                lambda a: a["n"],
            ),
        }
    )
    # only texts with some window twice are sorted
    step = step.withColumn(
        "__sorted",
        _once(
            F.when(
                F.size(F.array_distinct("__windows")) < F.size("__windows"),
                F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        ),
    )
    twice = F.filter(
        "__sorted",
        lambda e, i: F.coalesce(F.get("__sorted", i - 1)["h"] == e["h"], F.lit(False))
        | F.coalesce(F.get("__sorted", i + 1)["h"] == e["h"], F.lit(False)),
    )
    positions = F.sort_array(F.transform(twice, lambda e: e["i"]))
    return step.withColumn("n_repeat_words", _covered(positions)).drop(
        "__words", "__lines", "__hashes", "__windows", "__sorted"
    )
