"""Readers for labelled messages, noise pools, conflict lists and training histories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

MESSAGE_SCHEMA = StructType(
    [
        StructField("sentiment", IntegerType()),
        StructField("message", StringType()),
        StructField("tweetid", LongType()),
    ]
)

# Quoted fields may hold line breaks, doubled quotes and outer blanks; all are kept as they are.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

# Encodings in the order in which they are tried, by their Java names.
ENCODINGS = ("UTF-8", "UTF-16", "GB18030", "ISO-8859-1")


def read_messages(
    spark: SparkSession, path: str | Sequence[str], schema: StructType = MESSAGE_SCHEMA, encoding: str = "UTF-8"
) -> DataFrame:
    """Labelled messages from CSV with a header. ``multiLine`` keeps one file in one task, so a large
    collection should come as many files; ``read_messages_split`` reads a large file in many tasks."""
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True).option("encoding", encoding)
    return reader.csv(path if isinstance(path, str) else list(path))


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record) of UTF-8 CSV files with a header, in as many tasks as the files have blocks.

    A line starts a record if the quotes before it are even in number. Quotes are counted by block; running sums over the
    blocks of a file, one row each, give the state in which a block begins and the record it goes on with. Lines move
    once, by block. Quotes must be as RFC 4180 has them: around a whole field, doubled inside. Headers and blank records are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"),
    )
    block = Window.partitionBy("file", "block")
    before = block.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    lines = lines.withColumn("header", F.min(F.when(F.trim("value", F.lit(" \r")) != "", F.col("pos"))).over(block))
    ends = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("odd"),
        *[F.max(F.when(F.col("inside") == i, F.col("pos"))).alias(f"last{i}") for i in (0, 1)],
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("state", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    # a line whose quotes in the block before it are as odd as the state starts a record
    last = F.when(F.col("state") == 0, F.col("last0")).otherwise(F.col("last1"))
    ends = ends.withColumn("last", F.when(last.isNotNull(), F.struct("block", last.alias("pos"))))
    ends = ends.select("file", "block", "state", F.last("last", ignorenulls=True).over(earlier).alias("open"))
    here = F.struct("block", "pos")
    starts = F.col("inside") == F.col("state")
    so_far = block.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(ends, ["file", "block"]).select(
        "file", "block", "pos", "value", "odd", starts.alias("starts"),
        F.coalesce(F.last(F.when(starts, here), ignorenulls=True).over(so_far), "open").alias("start"),
        F.struct(F.lit(0).cast("bigint").alias("block"), F.when(F.col("block") == 0, F.col("header")).alias("pos")).alias("first"),
    )
    alone = F.col("starts") & (F.col("odd") == 0)
    whole = placed.filter(alone & ~F.col("start").eqNullSafe(F.col("first"))).select("file", F.col("value").alias("record"))
    parts = (
        placed.filter(~alone).groupBy("file", "start")
        .agg(F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("lines"), F.bool_or(F.col("start").eqNullSafe(F.col("first"))).alias("header"))
        .filter(~F.col("header"))
        .select("file", F.array_join(F.col("lines.value"), "\n").alias("record"))
    )
    records = whole.unionByName(parts).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.filter(F.trim("record") != "")


def read_messages_split(spark: SparkSession, path: str | Sequence[str], schema: StructType = MESSAGE_SCHEMA) -> DataFrame:
    """The rows of ``read_messages`` from UTF-8 files, each read by as many tasks as it has blocks. Line breaks inside quotes
    stay as they are, also in files whose lines end in CRLF, where the whole-file reader turns CRLF into LF."""
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": "true"}
    return csv_records(spark, path).select(F.from_csv("record", schema.toDDL(), options).alias("row")).select("row.*")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding): the first encoding in which every line of the file is well-formed.

    The text source keeps raw bytes, so files are checked line by line on all executors. Pure ASCII
    lines are valid in each encoding and are filtered out on the JVM side.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    files = lines.select("file").distinct()
    odd = lines.filter(~F.is_valid_utf8("value") | (F.octet_length("value") != F.char_length("value"))).select(
        "file", F.is_valid_utf8("value").alias("utf8"), F.col("value").cast("binary").alias("bytes")
    )

    def gb18030_ok(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "file": batch["file"],
                    "utf8": batch["utf8"],
                    "bom": [b[:2] in (b"\xff\xfe", b"\xfe\xff") for b in batch["bytes"]],
                    "gb": [_decodes(b, "gb18030") for b in batch["bytes"]],
                }
            )

    checked = odd.mapInPandas(gb18030_ok, "file string, utf8 boolean, bom boolean, gb boolean")
    verdict = checked.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("bom").alias("bom"),
                                          F.bool_and("gb").alias("gb"))
    utf8, utf16, gb, latin = ENCODINGS
    encoding = (
        F.when(F.coalesce("utf8", F.lit(True)), utf8).when(F.col("bom"), utf16).when(F.col("gb"), gb).otherwise(latin)
    )
    return files.join(verdict, "file", "left").select("file", encoding.alias("encoding"))


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def read_encoding_fallback(spark: SparkSession, path: str, schema: StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Labelled messages from files of unknown encoding; one read per encoding that occurs.

    Only file names and encodings reach the driver, as they do in any file listing. Spark reads GB18030
    only with ``spark.sql.legacy.javaCharsets``, which is switched on when such a file is found.
    """
    by_encoding: dict[str, list[str]] = {}
    for row in detect_encodings(spark, path).collect():
        by_encoding.setdefault(row["encoding"], []).append(row["file"])
    if "GB18030" in by_encoding:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    parts = [read_messages(spark, sorted(files), schema, enc) for enc, files in sorted(by_encoding.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files ``<name>.csv`` below ``path``, one list for each header line that occurs among them."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    lines = lines.filter(F.col("_metadata.file_name").rlike(r"^[^.]+\.csv$") & (F.col("_metadata.file_block_start") == 0))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("pos"))
    first = lines.filter(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return [[unquote(f) for f in r["files"]] for r in groups.collect()]


def read_noise_pool(spark: SparkSession, root: str, sources: Sequence[str]) -> DataFrame:
    """All noise files below ``root/<source>/``: (source, message, sentiment, tweetid).

    Taken are files named ``<name>.csv`` without a further dot, each by its own header: columns may come in any
    order, further ones are left out, and a file without ``sentiment`` or ``tweetid`` gives nulls. One read per header that
    occurs; only file names and headers reach the driver. A file without a ``message`` column is an error.
    """
    pool = spark.createDataFrame([], StructType([StructField("source", StringType()), *MESSAGE_SCHEMA.fields]))
    for source in sources:
        for files in files_by_header(spark, f"{root}/{source}"):
            rows = spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(files)
            columns = [F.lit(source).alias("source"), F.col("message")]
            columns += [F.col(f.name).cast(f.dataType) for f in MESSAGE_SCHEMA if f.name != "message" and f.name in rows.columns]
            pool = pool.unionByName(rows.select(*columns), allowMissingColumns=True)
    return pool.select("source", "message", "sentiment", "tweetid")


def read_conflict_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) from lines of two row numbers with white space between them."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        parts[0].cast("bigint").alias("a"), parts[1].cast("bigint").alias("b")
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """(run, epoch, loss, accuracy, val_loss, val_accuracy) from one CSV per run, addressed by name.

    ``path`` is a folder or glob of files or folders ``Hist_<run>.csv``. Files without an ``epoch``
    column are one task each (``multiLine``), so the line order gives the epoch.
    """
    names = ["loss", "accuracy", "val_loss", "val_accuracy"]
    rows = spark.read.options(**CSV_OPTIONS).option("multiLine", True).csv(path)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"Hist_([^/]*?)(?:\.csv)?(?:/|$)", 1)
    rows = rows.withColumn("run", run)
    if "epoch" not in rows.columns:
        rows = rows.withColumn("__pos", F.monotonically_increasing_id())
        first = rows.groupBy("run").agg(F.min("__pos").alias("__first"))
        rows = rows.join(first, "run").withColumn("epoch", F.col("__pos") - F.col("__first"))
    return rows.select("run", F.col("epoch").cast("int").alias("epoch"), *[F.col(n).cast("double") for n in names])
