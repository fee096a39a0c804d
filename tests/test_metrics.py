import random

import math

import pytest

from chatloom.operators import metrics


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1.0, 2.0), (3.0, 3.5), (5.0, 4.0)], "label double, prediction double")


def test_regression_metrics(small):
    row = metrics.regression_metrics(small).first()
    assert row["n"] == 3 and row["mse"] == 0.75 and row["r2"] == 0.71875
    assert math.isclose(row["rmse"], math.sqrt(0.75)) and math.isclose(row["mae"], 2.5 / 3)


def test_r2_of_a_constant_label_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert metrics.regression_metrics(df).first()["r2"] is None


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0), (1, 1.0), (0, 0.0)], "label int, prediction double")
    assert metrics.accuracy(df).first()["accuracy"] == 0.75


def report(spark, rows):
    df = spark.createDataFrame(rows, "label int, prediction int")
    return {r["class"]: r for r in metrics.classification_report(df).collect()}


def test_report(spark):
    got = report(spark, [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2)
    assert got["0"]["precision"] == 0.6 and got["0"]["recall"] == 0.75 and got["0"]["support"] == 4
    assert math.isclose(got["1"]["precision"], 2 / 3) and got["1"]["recall"] == 0.5
    assert got["accuracy"]["f1"] == 0.625 and got["accuracy"]["support"] == 8
    assert math.isclose(got["macro avg"]["recall"], 0.625)
    assert math.isclose(got["weighted avg"]["precision"], (0.6 * 4 + 2 / 3 * 4) / 8)


def test_report_of_one_class_and_zero_division(spark):
    assert set(report(spark, [(1, 1)])) == {"1", "accuracy", "macro avg", "weighted avg"}
    got = report(spark, [(0, 1), (0, 1)])
    assert got["0"]["recall"] == 0 and got["0"]["precision"] == 0 and got["0"]["f1"] == 0
    assert got["1"]["support"] == 0 and got["1"]["recall"] == 0


def test_area_under_roc_counts_ties_half(spark):
    df = spark.createDataFrame(
        [(1.0, 0.9), (1.0, 0.5), (0.0, 0.5), (0.0, 0.1)], "label double, score double"
    )
    assert metrics.area_under_roc(df).collect() == [(4, 0.875)]
    assert metrics.area_under_roc(df.where("label = 1")).collect() == [(2, None)]
    assert metrics.area_under_roc(df.limit(0)).collect() == [(0, None)]


def test_area_under_roc_over_many_ranges_of_scores(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(2000)]
    hits, misses = ([s for l, s in rows if l == side] for side in (1, 0))
    pairs = sum((h > m) + (h == m) / 2 for h in hits for m in misses)
    found = metrics.area_under_roc(spark.createDataFrame(rows, "label int, score double").repartition(9)).first()
    assert found["n"] == 2000 and abs(found["area_under_roc"] - pairs / len(hits) / len(misses)) < 1e-12
