"""Plans that must hold at scale: what is scanned, shuffled, broadcast and expanded."""

import re

import pytest

from chatloom.operators import sampling, stats
from chatloom.plans import bindings
from chatloom.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Queries that run Spark jobs while they are built: reading their plan would repeat the tests above.
EAGER = {name for name in QUERIES if name.startswith("model_")} | {
    "text_classifier", "toxicity_classifier", "vector_classifier", "sentence_vector_classifier", "tfidf_features",
    "saved_regressors", "pipeline_reload",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_query_crosses_rows_or_starts_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert operator not in plan


def test_statistics_need_no_expand_and_two_shuffles(spark):
    for build in (stats.author_stats, stats.member_stats):
        plan = plan_of(build(bindings.chat(spark, SF_DIR)))
        assert "Expand" not in plan
        assert plan.count("Exchange hashpartitioning") == 2
        assert re.search(r"hashpartitioning\(author#\w+, _groupingexpression#\w+, channel#", plan)


def test_statistics_read_only_their_columns(spark):
    plan = plan_of(stats.superchat_stats(bindings.superchat(spark, SF_DIR)))
    assert "ReadSchema: struct<l_suppkey:bigint,l_discount:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "EqualTo(l_returnflag,R)" in plan


def test_combined_stats_join_adds_no_shuffle(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(stats.combined_stats(
            bindings.chat(spark, SF_DIR), bindings.superchat(spark, SF_DIR)
        ))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 3


def test_samples_rank_hashes_only(spark):
    """No column of the table passes through a window; whole rows are joined last."""
    documents = bindings.documents(spark, SF_DIR)
    for df in (sampling.sample_n(documents, 20), sampling.resample_n(documents, 20)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("text#" not in line for line in windows)
        below = plan.split("Window [")[1:]
        assert all("text#" not in part.split("Join")[0] for part in below)


def scans_of(df):
    return plan_of(df).count("FileScan parquet")


def test_tables_are_scanned_once(spark):
    assert scans_of(QUERIES["label_from_source"](spark, SF_DIR)) == 2  # documents and labels
    assert scans_of(QUERIES["binary_auc"](spark, SF_DIR)) == 2  # stored scores: ranges, and the ranges' sums
    assert scans_of(QUERIES["period_split"](spark, SF_DIR)) == 2  # stored statistics and marks
    assert scans_of(QUERIES["channel_series_chat"](spark, SF_DIR)) == 3  # chats, channels and nations


def test_one_author_with_a_third_of_all_chats(spark):
    """A hot author's rows leave the first aggregation spread over all partitions."""
    from pyspark.sql import functions as F

    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("author"),
        (F.col("id") % 9000).alias("channel"), F.lit("2021-01-05 00:00:00").cast("timestamp").alias("ts"),
        F.lit(1).alias("bodylength"),
    )
    got = stats.author_stats(rows).where("author = 0").first()
    assert got["chats"] == 10000 and got["uniqueChatters"] == 3000 and got["totalBodyLength"] == 10000
