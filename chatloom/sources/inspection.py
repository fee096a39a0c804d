"""What is in files nobody has declared, and what in declared ones cannot be read.

Types are inferred once, by one aggregate over all rows, to be stored and declared from then on.
Lines that do not fit a declared schema go to a table of their own instead of becoming NULLs.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD_ROWS = "file string, block long, record string"
_RECORD = "_corrupt_record"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"


def _fits(value: Column) -> dict[str, Column]:
    """Whether a text is a value of each type, narrowest first; codes with leading zeros stay text."""
    whole = value.rlike(r"^([+-]?[1-9]\d*|0)$") & value.try_cast("bigint").isNotNull()
    number = value.rlike(_NUMBER) & ~value.rlike(r"^[+-]?0\d") & value.try_cast("double").isNotNull()
    date = value.rlike(_DATE) & value.try_cast("date").isNotNull()
    time = date | (value.rlike(_TIME) & value.try_cast("timestamp").isNotNull())
    return {"bigint": whole, "double": number, "date": date, "timestamp": time}


def inferred_types(texts: DataFrame) -> DataFrame:
    """``position``, ``column``, its narrowest ``type``, and how many values it has (``present``).

    ``texts`` has text columns, as a CSV file read without a schema. All rows decide, in one
    aggregate without a shuffle of rows; a column without any value is text.
    """
    counts, found = [], []
    for i, name in enumerate(texts.columns):
        value = F.col(f"`{name}`")
        kinds = _fits(value)
        counts.append(F.count(value).alias(f"_n{i}"))
        counts += [F.count_if(fits).alias(f"_{kind}{i}") for kind, fits in kinds.items()]
        type_ = F.lit("string")
        for kind in reversed(kinds):
            every = (F.col(f"_{kind}{i}") == F.col(f"_n{i}")) & (F.col(f"_n{i}") > 0)
            type_ = F.when(every, kind).otherwise(type_)
        found.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), type_.alias("type"), F.col(f"_n{i}").alias("present")))
    return texts.agg(*counts).select(F.inline(F.array(*found)))


def declared(types: DataFrame) -> StructType:
    """``inferred_types`` as the schema to read the files with from then on."""
    rows = sorted(types.collect(), key=lambda r: r["position"])
    return StructType.fromDDL(", ".join(f"`{r['column'].replace('`', '``')}` {r['type']}" for r in rows))


def infer_header_csv(spark: SparkSession, path: str) -> DataFrame:
    """``inferred_types`` of a CSV file with a header."""
    return inferred_types(spark.read.option("header", True).option("escape", '"').csv(path))


def read_checked_csv(
    spark: SparkSession, path: str | list[str], schema: StructType, header: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files that fit ``schema``, and the lines that do not, see ``BAD_ROWS``.

    A line is bad if it has too many or too few values or one that is not of its type; ``block`` is
    the byte at which the part of the file begins that a task read it from. Empty lines are no rows.
    """
    marked = StructType([*schema.fields, StructField(_RECORD, StringType())])
    rows = (
        spark.read.schema(marked).option("header", header).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD).option("escape", '"').csv(path)
    )
    # always true, but it takes all columns: Spark checks no value of a column that a query leaves out
    rows = rows.where(F.xxhash64(*(F.col(f"`{c}`") for c in schema.names)).bitwiseAND(F.lit(0)) == 0)
    metadata = F.col("_metadata")
    bad = rows.where(F.col(_RECORD).isNotNull()).select(
        metadata["file_path"].alias("file"), metadata["file_block_start"].alias("block"), F.col(_RECORD).alias("record"),
    )
    return rows.where(F.col(_RECORD).isNull()).drop(_RECORD), bad


def silent_files(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """The ``path`` of Parquet files in ``listed`` that cannot be read or hold no row.

    No column is read: a file with rows says so in its footer. ``listed`` is what
    ``incremental.source_files`` gives; its names pass through the driver.
    """
    paths = [r["path"] for r in listed.select("path").distinct().collect()]
    if not paths:
        return listed.select("path")
    reader = spark.read.schema("nothing int").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    name = F.col("_metadata.file_path")
    answered = reader.parquet(*paths).select(name.alias("path")).distinct()
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "file:/")
    answered = answered.select(plain("path").alias("_name")).distinct()
    names = listed.select("path").distinct().withColumn("_name", plain("path"))
    return names.join(answered, "_name", "left_anti").select("path")
