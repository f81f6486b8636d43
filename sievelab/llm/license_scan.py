"""Licence scan with Spark expressions and joins only.

Units of a file are its lines that mention a licence word, its leading comment block and the paragraphs of it when they mention
one, and, for licence files, the whole text. Equal units of all files are compared once: by the cosine of sparse TF-IDF vectors with
the templates of ``license_texts`` (whole texts, standard headers, notices, SPDX lines). Document frequencies are counted over all
units of all files and the templates, for every term; a term counts as 1 + ln of its number. A template fits if its
cosine reaches ``LEAST`` of its form and the words that name its licence stand in the unit. A file's own licence is the
template of the best cosine over its units. Licence files give their licence to their directory; a file without one of its own
takes that of its nearest ancestor directory, by a join of directories on ancestor paths.

Defined results: null texts have no units; null paths count as files of the root without a name; repeated rows get
equal results; of several licence files the best cosine counts, then the first path; of equal templates the first name; an
empty table gives an empty table; extra columns are left out. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import drop_path, pick, spread, written
from sievelab.llm.license_texts import NOTICES, Template, templates
from sievelab.operators.skew import lookup_join

#: Least cosine by form. Legal texts share much of their wording, so whole texts must agree further.
LEAST = {"header": 0.6, "id": 0.6, "notice": 0.6, "text": 0.75}
TEMPLATES = NOTICES
MENTION = "(?i)licen[sc]e|copyright|spdx|creative commons"
LICENSE_FILE = "(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
COMMENT_LINE = r"^\s*(#|//|--|;|%|\*|/\*|(?i:rem|dnl)\b|$)"
BLANK_COMMENT = r"^[^A-Za-z0-9]*$"
COMMENT_BLOCK = r'^\s*(?:#![^\n]*+\n\s*)?(/\*[\s\S]*?\*/|<!--[\s\S]*?-->|"""[\s\S]*?""")'
SPDX_ID = r"spdx-license-identifier:[ \t(]*([a-z0-9.+-]+)"


def terms_of(text: Column) -> Column:
    """Words of letters and digits, and each SPDX id as one more term."""
    lower = F.lower(text)
    ids = F.transform(F.regexp_extract_all(lower, F.lit(SPDX_ID), F.lit(1)), lambda i: F.concat(F.lit("spdx:"), i))
    return F.concat(F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t != ""), ids)


def template_terms(text: str) -> Counter:
    lower = text.lower()
    return Counter(re.findall("[a-z0-9]+", lower) + ["spdx:" + i for i in re.findall(SPDX_ID, lower)])


def _header(text: Column) -> Column:
    """The comment at the top of a file: one block, or the leading lines that are comments or blank."""
    lines = F.split(text, "\n")
    end = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT_LINE)), False)
    leading = F.when(end == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")))
    block = F.regexp_extract(text, COMMENT_BLOCK, 1)
    return F.when(block != "", F.split(block, "\n")).otherwise(leading)


def units_of(text: Column, name: Column) -> Column:
    """Texts to compare of one file, each once."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(MENTION))
    header = F.transform(_header(text), lambda x: F.when(x.rlike(BLANK_COMMENT), "").otherwise(x))
    joined = F.array_join(header, "\n")
    parts = F.filter(F.concat(F.array(joined), F.split(joined, "\n\n+")), lambda x: x.rlike(MENTION))
    whole = F.when(name.rlike(LICENSE_FILE) & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(lines, parts, whole))


def _postings(rows: list[Template], counts: list[Counter], idf: dict[str, float]) -> list[tuple]:
    """(term, [(place, weight, named)]): unit-length weights of the templates; ``named`` is 1 for a word that must occur."""
    out: dict[str, list] = {t: [] for t in idf}
    for place, (row, count) in enumerate(zip(rows, counts)):
        weights = {t: (1 + math.log(c)) * idf[t] for t, c in count.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        must = set(row.must.split())
        for t, w in weights.items():
            out[t].append((place, w / norm, int(t in must)))
    return list(out.items())


def best_templates(units: DataFrame, rows: list[Template] | None = None) -> DataFrame:
    """(unit, copies, license, score) of each distinct unit that a template fits. ``units`` has (unit, text), one row per occurrence."""
    spark = units.sparkSession
    rows = templates() if rows is None else rows
    counts = [template_terms(r.text) for r in rows]
    each = units.groupBy("unit").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    found, place = written(
        each.select("unit", "copies", F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("unit", "copies", "term").agg((1 + F.log(F.count("*"))).alias("tf")),
        "terms", with_path=True,
    )
    in_templates = Counter(t for c in counts for t in c)
    df = found.groupBy("term").agg(F.count("*").alias("rows"), F.sum("copies").alias("df"))
    # as many rows as the templates have words
    known = {r.term: r.df for r in df.join(F.broadcast(spark.createDataFrame([(t,) for t in in_templates], "term string")), "term").collect()}
    n = units.count() + len(rows)
    idf = {t: math.log((1 + n) / (1 + known.get(t, 0) + k)) + 1 for t, k in in_templates.items()}
    postings = spark.createDataFrame(
        [(t, idf[t], p) for t, p in _postings(rows, counts, idf)], "term string, known double, postings array<struct<place:int,weight:double,named:int>>"
    )
    other = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    weights = lookup_join(found, df, "term", F.col("unit"), "rows").join(F.broadcast(postings), "term", "left")
    weights = weights.withColumn("weight", F.col("tf") * F.coalesce("known", other))
    # place -1 gathers the squared length of the unit
    own = F.array(F.struct(F.lit(-1).alias("place"), F.col("weight"), F.lit(0).alias("named")))
    dots = (
        weights.select("unit", "copies", "weight", F.explode(F.concat(own, F.coalesce("postings", F.array().cast(postings.schema["postings"].dataType)))).alias("p"))
        .groupBy("unit", "copies", "p.place")
        .agg(F.sum(F.col("weight") * F.col("p.weight")).alias("dot"), F.sum("p.named").alias("named"))
    )
    about = spark.createDataFrame([(i, r.licence, LEAST[r.form], len(set(r.must.split()))) for i, r in enumerate(rows)], "place int, licence string, least double, must int")
    # at most as many entries a unit as there are templates
    fit = (
        dots.join(F.broadcast(about), "place", "left")
        .groupBy("unit", "copies")
        .agg(
            F.sqrt(F.max(F.when(F.col("place") < 0, F.col("dot")))).alias("norm"),
            F.collect_list(F.when(F.col("named") >= F.col("must"), F.struct("dot", "place", "licence", "least"))).alias("fits"),
        )
        .select("unit", "copies", F.transform(F.filter("fits", lambda f: f["dot"] >= f["least"] * F.col("norm")), lambda f: F.struct(
            F.round(f["dot"] / F.col("norm"), 9).alias("score"), (-f["place"]).alias("place"), f["licence"].alias("licence"))).alias("fits"))
        .filter(F.size("fits") > 0)
        .select("unit", "copies", F.array_max("fits").alias("best"))
        .select("unit", "copies", F.col("best.licence").alias("license"), F.col("best.score").alias("score"))
    )
    fit = written(fit, "licences")
    drop_path(spark, place)
    return fit


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", rows: list[Template] | None = None) -> DataFrame:
    """Per row: path, own_license, own_score, license, inherited_from (a directory, or null). ``rows`` are templates in place of the usual ones."""
    all_files = pick(files, path=F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    all_files = spread(all_files, "path").withColumn("file", F.xxhash64("path", "text"))
    name = F.element_at(F.split("path", "/"), -1)
    units = written(
        all_files.select("path", "file", F.explode(units_of(F.col("text"), name)).alias("text")).distinct()
        .withColumn("unit", F.unhex(F.md5(F.col("text").cast("binary")))),
        "units",
    )
    best = best_templates(units.select("unit", "text"), rows)
    own = (
        lookup_join(units.select("path", "file", "unit"), best, "unit", F.col("file"), "copies")
        # of equal scores the first name
        .groupBy("path", "file").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), F.col("license"))).alias("own_license"))
        .select("path", "file", "own_license", F.round("score", 6).alias("own_score"))
    )
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    granted = (
        own.filter(name.rlike(LICENSE_FILE))
        .groupBy(directory.alias("ancestor"))
        .agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("path"))).alias("granted"))
    )
    # directories once each, however many files they hold
    steps = F.split("directory", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    nearest = (
        all_files.select(directory.alias("directory")).distinct()
        .select("directory", F.explode(F.array_distinct(ancestors)).alias("ancestor"))
        .join(granted, "ancestor")
        .groupBy("directory")
        .agg(F.max_by(F.struct("granted", "ancestor"), F.length("ancestor")).alias("from"))
    )
    kept = all_files.select("path", "file", directory.alias("directory")).join(own, ["path", "file"], "left").join(nearest, "directory", "left")
    return kept.select(
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "from.granted").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("from.ancestor")).alias("inherited_from"),
    )
