"""Writers: replace, write once, reuse or compute."""

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    """True when a finished job wrote this folder: the marker is the last file committed.

    A folder with other content is someone else's, or a job's that keeps no marker: an error.
    """
    where, files = _files(spark, path)
    if not files.exists(where):
        return False
    if files.exists(_files(spark, f"{path.rstrip('/')}/_SUCCESS")[0]):
        return True
    if len(files.listStatus(where)):
        raise FileExistsError(f"{path} holds data without a marker of a finished write")
    return False


def _write_new(df: DataFrame, path: str, format: str, partition_by: Sequence[str] = ()) -> None:
    """Write beside ``path`` and move there when all is written, so a broken write leaves nothing at it."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    if partition_by:
        df = df.hint("rebalance", *map(F.col, partition_by))
    df.write.partitionBy(*partition_by).format(format).save(beside)
    target, files = _files(spark, path)
    if files.exists(target) and not len(files.listStatus(target)):
        files.delete(target, False)  # an empty folder, else the move would go inside it
    if files.exists(target) or not files.rename(_files(spark, beside)[0], target):
        raise FileExistsError(f"{path} was written meanwhile; the rows are in {beside}")


def replace(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    single_file: bool = False,
    **options,
) -> None:
    """Write over whatever is at ``path``.

    With ``partition_by`` rows of one folder are brought together first, so that tasks times
    folders small files do not pile up; adaptive execution splits a folder that is too large
    for one task. ``single_file`` sends all rows through one task; it is meant for small reports.
    """
    if single_file:
        df = df.coalesce(1)
    elif partition_by:
        df = df.hint("rebalance", *map(F.col, partition_by))
    df.write.mode("overwrite").partitionBy(*partition_by).format(format).options(**options).save(
        path
    )


def replace_csv(
    df: DataFrame, path: str, header: bool = False, single_file: bool = False, records_per_file: int = 0
) -> None:
    """CSV whose text survives a round trip: quotes doubled, white space kept.

    Text with line breaks is read one task a file; ``records_per_file`` bounds those tasks.
    """
    replace(
        df, path, "csv", single_file=single_file, header=header, escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=records_per_file,
    )


def write_once(df: DataFrame, path: str, format: str = "json") -> bool:
    """Write documents unless ``path`` already holds a finished write; True if written.

    Nothing is ever overwritten: a folder with unmarked content raises FileExistsError.
    """
    if _complete(df.sparkSession, path):
        return False
    _write_new(df, path, format)
    return True


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    schema: StructType | None = None,
) -> DataFrame:
    """Read the table at ``path``; where no finished write is there, build and write it first.

    ``schema`` keeps partition values in their type; it is taken from ``build`` where not given
    and the table is built. Unmarked content raises FileExistsError.
    """
    if not _complete(spark, path):
        built = build()
        schema = schema or built.schema
        _write_new(built, path, "parquet", partition_by)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_split(df: DataFrame, folder: str, split: str = "split", sides: Sequence[str] = ("train", "test")) -> list[str]:
    """One CSV folder with a header for each side of a split; gives their paths."""
    paths = [f"{folder.rstrip('/')}/{side}" for side in sides]
    for side, path in zip(sides, paths):
        replace_csv(df.where(F.col(split) == side).drop(split), path, header=True)
    return paths


def write_predictions(predictions: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named plain columns of a model's output as JSON; vectors and other columns stay out."""
    replace(predictions.select(*columns), path, "json")
