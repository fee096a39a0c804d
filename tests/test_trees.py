import random

import pytest
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from chatloom.operators import trees
from chatloom.operators.features import STATS_FEATURES
from chatloom.plans import fitted_sql, oracles
from check_oracles import connect


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 50), rng.random() * 1e6, float(rng.randint(0, 3)), rng.gauss(0, 1)) for _ in range(1500)]
    rows = [(a, b, c, d, (a % 7) * 2 + (b > 5e5) * 3 + (c in (0, 2)) * 5 + d) for a, b, c, d in rows]
    table = spark.createDataFrame(rows, "a int, b double, c double, d double, y double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="raw").transform(table)


@pytest.mark.parametrize("kind", ["tree", "forest", "stump"])
def test_compiled_trees_predict_the_same_numbers(data, kind):
    indexed = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6).fit(data).transform(data)
    model = {
        "tree": DecisionTreeRegressor(labelCol="y", maxDepth=8), "stump": DecisionTreeRegressor(labelCol="y", maxDepth=0),
        "forest": RandomForestRegressor(labelCol="y", maxDepth=6, numTrees=12, seed=3),
    }[kind].fit(indexed)
    both = model.transform(indexed).withColumn("compiled", trees.compiled(model, ["a", "b", "c", "d"]))
    assert both.where("NOT (prediction <=> compiled)").count() == 0


def test_compiled_trees_read_plain_columns_only(data, spark, tmp_path):
    model = DecisionTreeRegressor(labelCol="y").fit(data.withColumnRenamed("raw", "features"))
    expression = trees.compiled(model, ["a", "b", "c", "d"])
    data.write.parquet(str(tmp_path / "rows"))
    plan = spark.read.parquet(str(tmp_path / "rows")).select(expression.alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int,b:double,c:double,d:double>" in plan and "UDF" not in plan
    missing = spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)], "a int, b double, c double, d double")
    assert [r[0] for r in missing.select(expression).collect()] == [None, None]


@pytest.mark.parametrize(("penalty", "share"), [(0.01, 0.8), (0.05, 0.5), (0.002, 1.0)])
def test_elastic_net_in_sql_where_terms_stay(spark, monkeypatch, penalty, share):
    """The registered penalty leaves no term on these tables; smaller ones do."""
    monkeypatch.setattr(fitted_sql, "PENALTY", penalty)
    monkeypatch.setattr(fitted_sql, "ABSOLUTE_SHARE", share)
    con = connect("/root/testdata/sf0.001")
    source = oracles.REGRESSION_ROWS
    names = ", ".join(f"x{i + 1} AS \"{c}\"" for i, c in enumerate(STATS_FEATURES))
    rows = con.sql(f"SELECT {names}, y FROM ({source}) WHERE split = 'train'").df()
    table = VectorAssembler(inputCols=STATS_FEATURES, outputCol="features").transform(spark.createDataFrame(rows))
    model = LinearRegression(labelCol="y", maxIter=500, tol=1e-12, regParam=penalty, elasticNetParam=share).fit(table)
    found = con.sql(fitted_sql.elastic_net(source, sweeps=3000)).fetchall()[0]
    assert sum(c != 0 for c in found[1:]) >= 1
    assert found == pytest.approx([model.intercept, *model.coefficients], abs=1e-6)


def test_leaderboard_scores_compiled_trees_like_models(spark):
    from chatloom.operators import models
    from chatloom.plans import jobs, registry

    data = registry._regression_data(spark, "/root/testdata/sf0.001")
    board = {r["model"]: r for r in models.leaderboard(data, [jobs.LABEL]).collect()}
    for name in models.TREES:
        model = models.fit_regressor(models.regressors(jobs.LABEL)[name], data)
        alone = models.score_regressors({name: model}, data, jobs.LABEL).first()
        assert list(map(str, board[name]))[:2] == list(map(str, alone))[:2]
        assert list(board[name])[2:] == pytest.approx(list(alone)[2:], rel=1e-9)
    assert data.where(F.col("split").isNull()).count() == 0
