"""Work that tasks do in Python, on Arrow batches or on groups."""

import os

from pyspark.sql import DataFrame, GroupedData, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they see the same folder.

    On other clusters the package is shipped with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (*paths, _ROOT) if p)


def arrow_map(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` takes and gives an iterator of Arrow batches, one call for each partition."""
    _reachable(rows.sparkSession)
    return rows.mapInArrow(function, schema)


def group_map(spark: SparkSession, groups: GroupedData, function, schema: str) -> DataFrame:
    """``function`` takes and gives the pandas rows of one group."""
    _reachable(spark)
    return groups.applyInPandas(function, schema)


def arrow_cogroup_map(spark: SparkSession, left: GroupedData, right: GroupedData, function, schema: str) -> DataFrame:
    """``function`` takes and gives the Arrow tables of one key, those of both sides."""
    _reachable(spark)
    return left.cogroup(right).applyInArrow(function, schema)


def fresh(rows: DataFrame, name: str) -> str:
    """``name``, lengthened until ``rows`` has no such column."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
