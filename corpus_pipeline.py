"""From raw documents to packed training windows, in five stages.

Each stage takes all rows its predecessor kept. Between stages the rows are written as Parquet
to the shared folder and read again, so a lost executor costs a stage at most.
"""

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import decontam, packing, pii, quality, simhash
from chatloom.llm.queries import quality_weights
from chatloom.session import pinned


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality_weights(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.decontaminated(docs, decontam.indexes(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.masked(docs, pii.fit(docs))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2,048 ids."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("packing", packed_windows),
]

#: The classifier, the recogniser and the tokenizer cannot be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = pinned(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
