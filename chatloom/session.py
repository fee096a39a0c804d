"""Session settings and the shared folder for intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}
SHUFFLE_PARTITION_BYTES = 128 * 1024 ** 2


def shuffle_settings(shuffle_bytes: int) -> dict[str, str]:
    """Shuffles wide enough that each part of the largest one fits an executor's memory.

    Adaptive execution joins parts that turn out small but never widens a shuffle, so the
    first width has to suit the largest shuffle to expect.
    """
    width = max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES))
    return {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(width)}


def chat_session(
    builder: SparkSession.Builder = SparkSession.builder, shuffle_bytes: int | None = None
) -> SparkSession:
    """A session with the settings used here; give ``shuffle_bytes`` on a large cluster."""
    settings = SETTINGS | (shuffle_settings(shuffle_bytes) if shuffle_bytes else {})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach.

    Taken from ``spark.checkpoint.dir``. Where the session names none, a folder beside the
    session's tables serves, since the warehouse is shared like they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/chatloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, in a folder per application that can go after it."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str = "table", row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once, for callers that read it many times.

    A lost executor costs a re-read of the files, not a re-run of the lineage, and each reader
    takes only the columns it needs. The files stay until ``unpin`` or ``remove_intermediate``.
    A task holds a row group while it writes and while it reads, and at least a hundred rows: give
    ``row_group_bytes`` where rows are large.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if row_group_bytes:
        writer = writer.options(**{"parquet.block.size": row_group_bytes, "parquet.block.size.row.check.min": 1})
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._pinned_path = path
    return table


def unpin(*tables: DataFrame) -> None:
    """Delete the files of ``pinned`` tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._pinned_path)


def remove_intermediate(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, when its results are stored."""
    _delete(spark, _application_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
