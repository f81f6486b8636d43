"""Porter's suffix stripper (1980) with its common extensions, applied to distinct words of a batch.

The rules are data; the measure of a stem is read off its consonant/vowel pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

# Irregular forms and the suffix rules of each step.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
DOUBLE_SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
FULL_SUFFIXES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
LAST_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _pattern(word: str) -> str:
    """'c' or 'v' per letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out.endswith("c"))
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c+", _pattern(stem)))


def _short_end(stem: str) -> bool:
    pattern = _pattern(stem)
    return pattern == "vc" or (pattern.endswith("cvc") and stem[-1] not in "wxy")


def _replace(word: str, rules: list[tuple[str, str]], allowed: Callable[[str], bool]) -> str:
    """The first rule whose suffix fits decides; if its stem is not allowed the word stays."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if allowed(stem) else word
    return word


def _past_and_ing(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _pattern(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _pattern(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _pattern(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double_suffix(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, DOUBLE_SUFFIXES, lambda s: _measure(s) > 0)


def _last_suffix(word: str) -> str:
    for suffix in LAST_SUFFIXES:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st")
            return stem if fits else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if len(word) == 4 and word.endswith("ies"):
        word = word[:-1]
    else:
        word = _replace(word, PLURALS, lambda s: True)
    word = _final_y(_past_and_ing(word))
    word = _replace(_double_suffix(word), FULL_SUFFIXES, lambda s: _measure(s) > 0)
    return _tidy(_last_suffix(word))


def stem_tokens(tokens: Column | str) -> Column:
    """Stem every token of an array column.

    Runs map-side on Arrow batches: the tokens of a batch are dictionary-encoded, each distinct word is
    stemmed once, and the arrays are rebuilt by index, so no token is shuffled.
    """

    @F.arrow_udf("array<string>")
    def stem_batch(column: pa.Array) -> pa.Array:
        words = column.flatten().dictionary_encode()
        stems = pa.array([stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
        flat = pc.take(stems, words.indices)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(
            pc.fill_null(pc.list_value_length(column), 0)).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(column))

    return stem_batch(tokens)
