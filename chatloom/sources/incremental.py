"""Tables by source period that are brought up to date where their source files changed.

A manifest beside the table says from which files (name, size, time) each period was built. A run
lists the files, compares, and builds and overwrites only the periods whose files are not those of
the manifest. The manifest is written last: after a failure the same periods are built again, and
since a period is always overwritten whole, building one twice does no harm.
"""

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .writers import _files

SOURCE_PERIOD = "source_period"
FILES = "source_period string, path string, bytes long, modified timestamp"


def source_files(
    spark: SparkSession, folder: str, prefix: str, period: str = r"(\d{4}-\d{2})", exclude: Iterable[str] = ()
) -> DataFrame:
    """Files of the entries of ``folder`` whose name starts with ``prefix``, see ``FILES``.

    The period is what ``period`` finds first in the entry's name; an entry without one is an error.
    Entries whose name holds a text of ``exclude`` are left out. Only names, sizes and times are read.
    """
    folder = folder.rstrip("/")
    try:
        found = spark.read.format("binaryFile").load(f"{folder}/{prefix}*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    name = F.regexp_extract("path", f"/{_literal(folder.rpartition('/')[2])}/({_literal(prefix)}[^/]*)", 1)
    wanted = F.lit(True)
    for text in exclude:
        wanted = wanted & ~F.col("_name").contains(text)
    part = F.regexp_extract("_name", period, 1)
    without = F.raise_error(F.concat(F.lit("no period in the name of "), "path")).cast("string")
    return found.withColumn("_name", name).where(wanted).select(
        F.when(part != "", part).otherwise(without).alias(SOURCE_PERIOD), "path",
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    where = f"{path.rstrip('/')}.manifest"
    place, files = _files(spark, where)
    if not files.exists(place):
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(where)


def changed_periods(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Periods with a file that is new, gone, or of another size or time than in the manifest."""
    now = listed.select("*", F.lit(1).alias("side"))
    then = manifest.select("*", F.lit(-1).alias("side"))
    differing = now.unionByName(then).groupBy(SOURCE_PERIOD, "path", "bytes", "modified").agg(F.sum("side").alias("side"))
    return differing.where("side <> 0").select(SOURCE_PERIOD).distinct()


def refresh(
    spark: SparkSession, listed: DataFrame, path: str, build: Callable[[list[str]], DataFrame]
) -> list[str]:
    """Bring the table at ``path`` up to date with the files of ``listed``; gives the periods built.

    ``build`` takes the paths of one period's files and gives its rows, which are stored under
    ``source_period``; all periods to build are one job. A period whose files are gone, or whose
    files give no row, has no rows left. Only changed periods and their files' names pass through
    the driver. Two runs at a time on one table are not guarded against.
    """
    path = path.rstrip("/")
    listed = listed.select(SOURCE_PERIOD, "path", "bytes", "modified")
    changed = changed_periods(listed, _manifest(spark, path))
    known = {r[0]: r[1] for r in changed.join(listed, SOURCE_PERIOD, "left").groupBy(SOURCE_PERIOD).agg(F.sort_array(F.collect_list("path"))).collect()}
    if not known:
        return []
    rows = None
    for period, paths in sorted(known.items()):
        if paths:
            built = build(paths).withColumn(SOURCE_PERIOD, F.lit(period))
            rows = built if rows is None else rows.unionByName(built)
    for period in known:  # what a build gives no rows for is not overwritten by them
        place, files = _files(spark, f"{path}/{SOURCE_PERIOD}={period}")
        files.delete(place, True)
    if rows is not None:
        rows = rows.hint("rebalance", F.col(SOURCE_PERIOD))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SOURCE_PERIOD).parquet(path)
    touched = listed.where(F.col(SOURCE_PERIOD).isin(list(known)))
    kept = _manifest(spark, path).where(~F.col(SOURCE_PERIOD).isin(list(known)))
    # written beside and moved, since it reads what it replaces
    beside = f"{path}.manifest.new"
    kept.unionByName(touched).coalesce(1).write.mode("overwrite").parquet(beside)
    place, files = _files(spark, f"{path}.manifest")
    files.delete(place, True)
    if not files.rename(_files(spark, beside)[0], place):
        raise FileExistsError(f"{path}.manifest was written meanwhile")
    return sorted(known)


def read_refreshed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``refresh`` keeps at ``path``; ``schema`` is that of the built rows."""
    whole = StructType([*schema.fields, StructField(SOURCE_PERIOD, StringType())])
    place, files = _files(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)
