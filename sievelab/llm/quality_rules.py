"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule names a ratio and the range in which it must lie. All ratios and verdicts are Spark expressions
of counts over the whole text; no user functions run.

Defined results: a null or blank text has no words, so it fails the base rule and is not kept. Equal rows
get equal verdicts, null ids stay null, an empty table gives an empty table, extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import pick, spread
from sievelab.llm.textstats import text_counts


@dataclass(frozen=True)
class Rule:
    """``low <= ratio <= high`` for texts of at least ``least_words`` words; None leaves a side open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: Ratios as SQL over the counts of ``text_counts``; a text without words has the ratio 0.
RATIOS = {
    "words": "double(n_words)",
    "mean_word_length": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0)",
    "marks_per_word": "coalesce(try_divide(n_marks, n_words), 0)",
    "stop_share": "coalesce(try_divide(n_stop, n_words), 0)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
}

RULES = (
    Rule("too_long", "words", high=10_000_000),
    Rule("word_length", "mean_word_length", low=2.0, high=15.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("marks", "marks_per_word", high=0.3),
    Rule("stop_words", "stop_share", low=0.01, least_words=100),
    Rule("dup_lines", "dup_line_share", high=0.5),
)

BASE_LEAST_WORDS = 10
BASE_REPEAT_PERCENT = 20


def _passes(rule: Rule) -> Column:
    ratio = F.expr(RATIOS[rule.ratio])
    tests = [F.lit(True)]
    if rule.low is not None:
        tests.append(ratio >= F.lit(float(rule.low)))
    if rule.high is not None:
        tests.append(ratio <= F.lit(float(rule.high)))
    both = reduce(lambda a, b: a & b, tests)
    return both if not rule.least_words else (F.col("n_words") < rule.least_words) | both


def _base_failed() -> Column:
    return (F.col("n_words") < BASE_LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * BASE_REPEAT_PERCENT
    )


def rule_verdicts(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id as ``doc_id``, all counts, ``base_failed``, ``failed`` (names of failed rules), ``kept``."""
    counted = text_counts(
        spread(pick(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), "doc_id")
    )
    failed = F.array_compact(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules])) if rules else F.array()
    return (
        counted.drop("text")
        .withColumns({"base_failed": _base_failed(), "failed": failed.cast("array<string>")})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def keep_by_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; rows are judged one by one, so equal ids do not mix."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    counted = text_counts(packed.withColumn("text", F.coalesce(F.col("row")[text_col], F.lit(""))))
    kept = reduce(lambda a, b: a & b, [_passes(r) for r in rules], ~_base_failed())
    return counted.filter(kept).select(*[F.col("row")[c].alias(c) for c in names])
