from collections import Counter

import pytest
from pyspark.sql import functions as F

from chatloom.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label")).cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_hash_split_is_complete_disjoint_and_close(rows, rows_under):
    split = sampling.hash_split(rows, ["id"], 0.2, 42)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and abs(counts["test"] - 600) < 80
    again = sampling.hash_split(rows.repartition(7), ["id"], 0.2, 42)
    assert sorted(map(str, split.collect())) == sorted(map(str, again.collect()))
    assert sampling.hash_split(rows, ["id"], 0.0, 1).where("split = 'test'").isEmpty()
    assert sampling.hash_split(rows, ["id"], 1.0, 1).where("split = 'train'").isEmpty()
    with pytest.raises(ValueError):
        sampling.hash_split(rows, ["id"], 1.5, 1)


def test_period_split_holds_out_whole_periods(spark):
    months = [f"2021-{m:02}" for m in range(1, 13)] + ["2022-1", "202202", "soon", ""]
    df = spark.createDataFrame([(m, i) for m in months for i in range(3)] + [(None, 0)], "period string, i int")
    got = sampling.period_split(df).collect()
    sides = {(r["period"], r["split"]) for r in got}
    assert len(got) == 49 and len(sides) == 17
    assert sum(side == "test" for _, side in sides) == 5 and (None, "train") in sides
    assert sampling.period_split(df, seed=7).collect() != got
    few = spark.createDataFrame([("a", 1), ("b", 2)], "period string, i int")
    assert {r["split"] for r in sampling.period_split(few).collect()} == {"train"}
    assert sampling.period_split(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 7, 99, 100])
def test_cut_is_the_nth_hash(spark, n):
    hashes = sorted(f"{i * i * 7919 % 65536:04x}{i:028x}" for i in range(100))
    rows = spark.createDataFrame([(h,) for h in hashes], "_order string")
    assert sampling.cut(rows, n) == hashes[n - 1] and sampling.cut(rows, 101) is None


@pytest.mark.parametrize("n", [0, 1, 50, 2999, 3000, 5000])
def test_sample_n_is_exact(rows, n):
    sample = ids(sampling.sample_n(rows, n))
    assert len(sample) == len(set(sample)) == min(n, 3000)


def test_sample_n_ignores_partitioning(rows, rows_under):
    def build():
        return sampling.sample_n(rows, 100)
    assert rows_under(build, 1) == rows_under(build, 200)
    assert ids(sampling.sample_n(rows.repartition(9), 100)) == ids(build())
    assert ids(sampling.sample_n(rows, 100, seed=1)) != ids(build())


@pytest.fixture(scope="module")
def copies(spark):
    """A third of the rows are copies of one row."""
    return spark.range(4000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"), F.lit("x").alias("w"))


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_copies_are_sampled_like_other_rows(copies):
    sample = values(sampling.sample_n(copies, 900))
    assert len(sample) == 900 and 240 < sample.count(-1) < 360
    others = [v for v in sample if v != -1]
    assert len(set(others)) == len(others)
    drawn = values(sampling.resample_n(copies, 5000))
    assert len(drawn) == 5000 and 1500 < drawn.count(-1) < 1830


def test_a_smaller_sample_is_part_of_a_larger_one(copies):
    small, large = (Counter(values(sampling.sample_n(copies, n))) for n in (50, 3000))
    assert not small - large and sum(small.values()) == 50 and sum(large.values()) == 3000


@pytest.mark.parametrize("build", [lambda d: sampling.sample_n(d, 700), lambda d: sampling.resample_n(d, 700)])
def test_samples_ignore_partitioning(copies, rows_under, build):
    first = rows_under(lambda: build(copies.repartition(1)), 1)
    assert first == rows_under(lambda: build(copies.repartition(7)), 7) == rows_under(lambda: build(copies.repartition(200)), 200)


def test_many_buckets_draw_the_same_rows(copies, monkeypatch):
    few = values(sampling.resample_n(copies, 800))
    monkeypatch.setattr(sampling, "ROWS_A_BUCKET", 3)
    assert values(sampling.resample_n(copies, 800)) == few


def test_null_and_empty_are_different_rows(spark):
    rows = spark.createDataFrame([(None, [1]), ("", [1]), ("-", [1]), (None, None)], "v string, a array<int>")
    drawn = {(r["v"], str(r["a"])) for r in sampling.resample_n(rows, 200).collect()}
    assert drawn == {(None, "[1]"), ("", "[1]"), ("-", "[1]"), (None, "None")}
    assert sampling.resample_n(rows.limit(0), 5).collect() == [] and sampling.sample_n(rows, 0).collect() == []


def test_downsample(rows):
    assert {r["label"] for r in sampling.downsample(rows, 0, 100).collect()} == {0}
    assert sampling.downsample(rows, 5, 100).count() == 0


def test_upsample_draws_with_replacement(rows):
    drawn = sampling.upsample(rows, 1, 900)
    assert drawn.columns == rows.columns
    counts = Counter(r["id"] for r in drawn.collect())
    assert sum(counts.values()) == 900 and all(i % 10 == 0 for i in counts)
    assert 200 < len(counts) <= 300 and max(counts.values()) < 15


def test_upsample_of_an_empty_class(rows):
    assert sampling.upsample(rows, 5, 10).count() == 0


def test_balance_after_the_split_shares_no_row(rows):
    split = sampling.hash_split(rows, ["id"], 0.2, 42)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    balanced = sampling.balance_classes(train, 500)
    assert {r["label"]: r["count"] for r in balanced.groupBy("label").count().collect()} == {0: 500, 1: 500}
    assert not set(ids(balanced)) & set(ids(test))
