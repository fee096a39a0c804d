"""Readers: parquet files picked by name, CSV files with a declared schema, labelled files."""

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from .. import schemas
from ..functions.casts import cast_columns
from ..functions.text import label_of_source


def read_named(
    spark: SparkSession,
    folder: str,
    prefix: str,
    exclude: Iterable[str] = (),
    schema: StructType | None = None,
) -> DataFrame:
    """All parquet entries of a folder whose name starts with ``prefix``, as one scan.

    An entry is a file or a folder of part files. One whose name holds a text of ``exclude``
    is left out and never opened: flagged chats, a file known to be corrupt. Only the entries'
    names pass through the driver, one or two per month.
    """
    place = f"/{re.escape(folder.rstrip('/').rpartition('/')[2])}/({re.escape(prefix)}[^/]*)"
    name = F.regexp_extract("path", place, 1)
    try:
        found = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{prefix}*")
        names = [r["name"] for r in found.select(name.alias("name")).distinct().collect()]
    except AnalysisException as error:
        raise FileNotFoundError(f"nothing to read in {folder}") from error
    unwanted = tuple(exclude)
    chosen = sorted(n for n in names if not any(x in n for x in unwanted))
    if not chosen:
        raise FileNotFoundError(f"no entry {prefix}* in {folder} outside {unwanted}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*(f"{folder.rstrip('/')}/{n}" for n in chosen))


def with_file_rows(scan: DataFrame) -> DataFrame:
    """Add ``file`` and ``row``, which together identify each row of a parquet scan.

    They stay the same however the scan is split or repeated, so they serve as sampling key
    for tables without one, even where many rows are copies of each other.
    """
    return scan.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )


def read_chats(spark: SparkSession, folder: str, corrupt: Iterable[str] = ()) -> DataFrame:
    """Monthly chat files without the flagged ones, in the column names used here."""
    return chat_columns(read_named(spark, folder, "chats_", ["flagged", *corrupt]))


def read_superchats(spark: SparkSession, folder: str, corrupt: Iterable[str] = ()) -> DataFrame:
    return superchat_columns(read_named(spark, folder, "superchats_", corrupt))


def chat_columns(raw: DataFrame) -> DataFrame:
    """author, channel, ts, bodylength, member of raw chats.

    Times, lengths and membership may be text; what cannot be read becomes NULL.
    """
    return raw.select(
        F.col("authorChannelId").alias("author"), F.col("channelId").alias("channel"), _time(raw),
        F.col("bodylength").try_cast("bigint").alias("bodylength"),
        (F.col("isMember").cast("string") == "true").alias("member"),
    )


def superchat_columns(raw: DataFrame) -> DataFrame:
    """author, ts, significance of raw super chats."""
    return raw.select(
        F.col("authorChannelId").alias("author"), _time(raw),
        F.col("significance").try_cast("double").alias("significance"),
    )


def _time(raw: DataFrame) -> Column:
    time = F.col("timestamp")
    if raw.schema["timestamp"].dataType == StringType():
        time = time.try_cast("timestamp")
    return time.alias("ts")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    header: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a declared schema; quotes inside quoted text are doubled.

    Without ``multiline`` each line is one record and large files are split between tasks;
    with it a quoted text may hold line breaks, and a file is one task's work.
    """
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("multiLine", multiline)
        .option("escape", '"')
        .csv(path)
    )


def read_numbered(
    spark: SparkSession, stem: str, numbers: Iterable[int], schema: StructType
) -> DataFrame:
    """Headerless CSV files or folders ``<stem><number>.csv`` as one scan, with their ``number``."""
    rows = read_csv(spark, [f"{stem}{n}.csv" for n in numbers], schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.csv", 1)
    return rows.withColumn("number", number.cast("int"))


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """Headerless combined statistics, found by position, under the column names used here."""
    return read_csv(spark, path, schemas.COMBINED_STATS).withColumnRenamed("id", "author")


def read_text_columns(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Header CSV read as text, then cast by name; unreadable values become NULL."""
    return cast_columns(spark.read.option("header", True).option("escape", '"').csv(path), types)


def read_header_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV whose columns are found by name and cast to ``schema``; others are dropped."""
    types = {f.name: f.dataType.simpleString() for f in schema if f.dataType != StringType()}
    return read_text_columns(spark, path, types).select(*schema.names)


def read_labelled(
    spark: SparkSession, nonflagged: str, flagged: str, schema: StructType | None = None
) -> DataFrame:
    """Stack non-flagged (label 0) and flagged (label 1) parquet files."""
    reader = spark.read.schema(schema) if schema else spark.read
    parts = [
        reader.parquet(path).withColumn("label", F.lit(label))
        for path, label in ((nonflagged, 0), (flagged, 1))
    ]
    return parts[0].unionByName(parts[1])


def with_label(df: DataFrame, source: str = "label") -> DataFrame:
    """Replace a source name by its 0/1 label."""
    return df.withColumn("label", label_of_source(F.col(source)))
