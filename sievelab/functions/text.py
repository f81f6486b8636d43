"""Text expressions; all of them run inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# White space as a language-neutral split sees it, and word characters.
WHITE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
WORD = r"[\p{L}\p{N}_]{2,}"
# Quotes that a word tokenizer sets apart, words it takes as two, the stop list of the topic model.
QUOTES = "«“‘„»”’"
CONTRACTIONS = {
    "cannot": ["can", "not"],
    "gimme": ["gim", "me"],
    "gonna": ["gon", "na"],
    "gotta": ["got", "ta"],
    "lemme": ["lem", "me"],
    "wanna": ["wan", "na"],
}
TOPIC_STOP_WORDS = ["for", "a", "of", "the", "and", "to", "in"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(text: Column | str) -> Column:
    """Lower case; each line feed and ASCII punctuation mark becomes a blank."""
    blanked = string.punctuation + "\n"
    return F.translate(F.lower(text), blanked, " " * len(blanked))


def split_words(text: Column | str) -> Column:
    return F.filter(F.split(text, WHITE_SPACE), lambda t: t != "")


def tokenize_words(text: Column | str) -> Column:
    """Word tokens of a normalised text: quotes stand alone, fused words are taken apart."""
    spaced = F.regexp_replace(text, f"([{QUOTES}])", " $1 ")

    def apart(token: Column) -> Column:
        parts = None
        for word, pieces in CONTRACTIONS.items():
            cond, value = token == word, F.array(*[F.lit(p) for p in pieces])
            parts = F.when(cond, value) if parts is None else parts.when(cond, value)
        return parts.otherwise(F.array(token))

    return F.flatten(F.transform(split_words(spaced), apart))


def tokenize_stoplist(text: Column | str, stop_words: Sequence[str] = tuple(TOPIC_STOP_WORDS)) -> Column:
    """Lower case, split on white space, without the stop words."""
    return F.filter(split_words(F.lower(text)), lambda t: ~t.isin(list(stop_words)))


def word_pattern_tokens(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Runs of at least two word characters, lower case, without the stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words))) if stop_words else tokens


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """All n-grams of ``low`` to ``high`` words, joined by blanks, shorter ones first.

    The token expression is bound to a lambda variable, so it is evaluated once and not once per use.
    """

    def grams(words: Column, n: int) -> Column:
        if n == 1:
            return words
        count = F.size(words) - (n - 1)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)]))

    def every(words: Column) -> Column:
        return F.concat(*[grams(words, n) for n in range(low, high + 1)])

    return F.get(F.transform(F.array(_col(tokens)), every), F.lit(0))


def one_hot(label: Column | str, labels: Sequence[int]) -> Column:
    """0/1 array over the known labels; an unknown label gives zeros only."""
    return F.array(*[F.coalesce((_col(label) == v).cast("int"), F.lit(0)) for v in labels])
