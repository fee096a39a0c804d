import hashlib
import math
import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from chatloom.operators import features, metrics, models
from chatloom.plans import jobs


@pytest.fixture(scope="module")
def planted(spark):
    """superchats follows the features; a fifth of the rows is held out."""
    draw = random.Random(3)
    rows = []
    for i in range(600):
        chats, days, channels, length = (draw.randint(1, 40) for _ in range(4))
        superchats = 1.0 + chats + 2.0 * days + draw.random()
        rows.append((chats, days, channels, length, superchats, math.log10(superchats),
                     "test" if i % 5 == 0 else "train"))
    columns = features.STATS_FEATURES + ["superchats", "log10_superchats", "split"]
    return features.assemble(spark.createDataFrame(rows, columns)).cache()


def test_leaderboard_has_every_model_and_beats_the_baseline(planted):
    board = models.leaderboard(planted, ["superchats", "log10_superchats"]).collect()
    by_label = {}
    for row in board:
        by_label.setdefault(row["label_col"], {})[row["model"]] = row
    assert set(by_label["superchats"]) == {
        "linear regression", "glm gaussian", "glm poisson", "glm gamma", "glm tweedie", "rfr",
        "dtr", "baseline",
    }
    assert set(by_label["log10_superchats"]) == set(by_label["superchats"]) - {"glm gamma"}
    base = by_label["superchats"]["baseline"]["Test MSE"]
    for name in ("linear regression", "glm gaussian", "glm poisson", "rfr", "dtr"):
        assert by_label["superchats"][name]["Test MSE"] < base / 2, name
    for row in board:
        assert math.isclose(row["Train RMSE"] ** 2, row["Train MSE"], rel_tol=1e-9)


def test_scores_equal_separate_metrics(planted):
    fitted = models.fit_regressor(models.decision_tree("superchats"), planted)
    row = models.score_regressors({"dtr": fitted}, planted, "superchats").first()
    test = fitted.transform(planted.where("split = 'test'"))
    alone = metrics.regression_metrics(test, "superchats").first()
    assert math.isclose(row["Test MSE"], alone["mse"]) and math.isclose(row["Test MAE"], alone["mae"])


def test_baseline_predicts_the_train_mean_on_both_parts(planted):
    row = models.score_regressors({}, planted, "superchats", baseline=True).first()
    mean = planted.where("split = 'train'").agg(F.avg("superchats")).first()[0]
    mse = planted.where("split = 'test'").agg(F.avg((F.col("superchats") - mean) ** 2)).first()[0]
    assert math.isclose(row["Test MSE"], mse)


def test_seeded_fits_repeat(planted):
    def score():
        fitted = models.fit_regressor(models.random_forest("superchats", seed=5), planted)
        return models.score_regressors({"rfr": fitted}, planted, "superchats").collect()
    assert score() == score()


def test_tweedie_settings(planted):
    plain = models.fit_regressor(models.generalized_linear_regression("superchats"), planted)
    gaussian = models.fit_regressor(models.generalized_linear_regression("superchats", "gaussian"), planted)
    assert plain.coefficients == gaussian.coefficients
    powered = models.generalized_linear_regression("superchats", variance_power=1.5, link_power=0.0)
    assert models.fit_regressor(powered, planted).coefficients != plain.coefficients
    linked = models.generalized_linear_regression("superchats", "poisson", link="identity")
    assert linked.getLink() == "identity"


def test_gamma_refuses_labels_that_are_not_positive(planted):
    zero = planted.withColumn("superchats", F.col("superchats") - F.col("superchats"))
    with pytest.raises(ValueError, match="positive"):
        models.fit_regressor(models.generalized_linear_regression("superchats", "gamma"), zero)


def test_saved_regressor_predicts_the_same(planted, tmp_path):
    fitted = models.fit_regressor(models.linear_regression("superchats"), planted)
    for _ in range(2):
        fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = LinearRegressionModel.load(str(tmp_path / "model"))
    one, two = (m.transform(planted).select("prediction").collect() for m in (fitted, loaded))
    assert one == two
    table = {r["term"]: r["weight"] for r in models.coefficients(loaded, features.STATS_FEATURES).collect()}
    assert table["(intercept)"] == fitted.intercept and table["chats"] > 0.5


@pytest.fixture(scope="module")
def reviews(spark):
    draw = random.Random(1)
    words = ["river", "stone", "cloud", "paper", "lamp"]
    rows = []
    for i in range(400):
        polarity = 1 + i % 2
        sign = ["awful", "broken"] if polarity == 1 else ["lovely", "superb"]
        body = [draw.choice(words) for _ in range(6)] + [draw.choice(sign)]
        draw.shuffle(body)
        rows.append((i, polarity, "t", " ".join(body)))
    return spark.createDataFrame(rows, "doc_id long, polarity int, title string, text string")


def test_text_classifier_learns_and_maps_polarity(reviews):
    row = jobs.classify_text(reviews).first()
    assert row["accuracy"] > 0.95 and row["area_under_roc"] > 0.95
    assert row["train_rows"] + row["test_rows"] == 400


def test_toxicity_classifier(reviews):
    toxic = reviews.withColumn("toxic", (F.col("polarity") == 1).cast("int"))
    assert jobs.classify_toxicity(toxic).first()["accuracy"] > 0.95


def test_pipelines_survive_saving(reviews, tmp_path):
    words = jobs.with_words(jobs.binary_labels(reviews))
    path = str(tmp_path / "unfitted")
    models.text_classifier().write().overwrite().save(path)
    fitted = Pipeline.load(path).fit(words)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    one, two = (m.transform(words).select("doc_id", "prediction").collect() for m in (fitted, loaded))
    assert sorted(one) == sorted(two)
    predictions = loaded.transform(words).select("doc_id", "label", "prediction")
    predictions.write.json(str(tmp_path / "json"))
    assert reviews.sparkSession.read.json(str(tmp_path / "json")).count() == 400


def test_tfidf_weights_follow_the_formula(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a", "c"],), (["d"],)], "words array<string>")
    vectors = [r["features"] for r in features.tfidf().fit(df).transform(df).collect()]
    assert vectors[0].size == 100_000
    weights = sorted(vectors[0].values)
    assert weights[0] == 0.0 and math.isclose(weights[1], 2 * math.log(4 / 3))
    terms = {r["token"]: r["idf"] for r in features.term_idf(df, F.col("words")).collect()}
    assert math.isclose(terms["a"], math.log(4 / 3)) and terms["b"] == 0.0


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.0, 1.0]), (2, None)], "k int, v array<float>")
    got = {r["k"]: r["vector"] for r in features.mean_pool(df, "k", "v").collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 1.0]}


def test_hashed_vectors(spark):
    def vector(token):
        bits = int(hashlib.md5(token.encode()).hexdigest(), 16)
        return [1.0 if bits >> (127 - i) & 1 else -1.0 for i in range(128)]

    df = spark.createDataFrame([(1, ["a", "bé", "a"]), (2, []), (3, None), (4, ["a"])], "k int, words array<string>")
    for size in (8, 40, 128):
        got = {r["k"]: r["vector"] for r in features.hashed_vectors(df.repartition(3), "k", size=size).collect()}
        mean = [(2 * a + b) / 3 for a, b in zip(vector("a"), vector("bé"))][:size]
        assert got[4] == vector("a")[:size] and got[2] == got[3] == [0.0] * size
        assert max(abs(x - y) for x, y in zip(got[1], mean)) < 1e-12
    with pytest.raises(ValueError):
        features.hashed_vectors(df, "k", size=129)


def test_sentence_vectors_are_means_of_sentences(spark):
    texts = spark.createDataFrame([(1, "river stone. lamp"), (2, "river stone"), (3, "lamp"), (4, ""), (5, None)], "k int, text string")
    got = {r["k"]: r["vector"] for r in jobs.sentence_vectors(texts, ["k"], size=16).collect()}
    assert len(got) == 5 and got[4] == got[5] == [0.0] * 16
    assert max(abs(a - (b + c) / 2) for a, b, c in zip(got[1], got[2], got[3])) < 1e-12 and any(got[1])


def test_sentence_vectors_shuffle_no_sentences(spark, tmp_path):
    """Bits are counted where a text is read: neither its tokens nor its sentences are rows of a shuffle."""
    texts = spark.createDataFrame([(i, f"river stone{i}. lamp post! " * 3) for i in range(20)], "k int, text string")
    plan = jobs.sentence_vectors(texts, ["k"], size=16)._jdf.queryExecution().executedPlan().toString()
    first = plan[plan.index("MapInArrow"):]
    assert "Generate" not in first[:first.index("\n")] and plan.count("Generate") == 1  # of repeated keys alone


def test_repeated_and_missing_keys_keep_their_sentence_vectors(spark):
    rows = [(1, "river stone. lamp"), (1, "lamp"), (2, "river stone"), (3, "lamp"), (None, "lamp"), (None, "x")]
    got = jobs.sentence_vectors(spark.createDataFrame(rows, "k int, text string"), ["k"], size=16).collect()
    by = {k: [r["vector"] for r in got if r["k"] == k] for k in (1, 2, 3, None)}
    assert [len(by[k]) for k in (1, 2, 3, None)] == [2, 1, 1, 2] and by[None] == [[0.0] * 16] * 2
    # both rows' first sentences are one sentence of three words
    first = [(2 * b + c) / 3 for b, c in zip(by[2][0], by[3][0])]
    assert by[1][0] == by[1][1] == pytest.approx([(a + c) / 2 for a, c in zip(first, by[3][0])])


def test_long_lists_and_missing_tokens_are_counted(spark):
    many = [None, *["a"] * 700, *["b"] * 300, ""]
    rows = [(1, many), (1, ["b"]), (2, [None]), (None, ["a"]), (3, []), (4, None), (None, None)]
    got = {r["k"]: r["vector"] for r in features.hashed_vectors(spark.createDataFrame(rows, "k int, words array<string>"), "k", size=12).collect()}
    bits = {t: [2 * (int(hashlib.md5(t.encode()).hexdigest(), 16) >> (127 - i) & 1) - 1 for i in range(12)] for t in ("a", "b", "")}
    assert got[1] == pytest.approx([(700 * a + 301 * b + e) / 1002 for a, b, e in zip(bits["a"], bits["b"], bits[""])])
    assert got[None] == bits["a"] and got[2] == got[3] == got[4] == [0.0] * 12


def test_missing_features_are_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, None)], "chats int, videoDays int, uniqueChatters int, totalBodyLength int")
    with pytest.raises(Exception, match="null"):
        features.assemble(rows).collect()


def test_vector_classifier_learns_a_planted_signal(spark):
    draw = random.Random(2)
    rows = [(i, i % 2, [draw.gauss(2.0 if i % 2 else -2.0, 1.0) for _ in range(4)]) for i in range(300)]
    df = features.vector_column(spark.createDataFrame(rows, "id int, label int, v array<double>"), "v")
    fitted = models.vector_classifier(4, 2, hidden=4).fit(df)
    assert metrics.accuracy(fitted.transform(df)).first()["accuracy"] > 0.95


@pytest.mark.parametrize("by_sentence", [False, True])
def test_classify_vectors_reports_each_class(reviews, by_sentence):
    toxic = reviews.withColumn("toxic", (F.col("polarity") == 1).cast("int"))
    report = jobs.classify_vectors(toxic, per_class=100, size=8, by_sentence=by_sentence)
    report = {r["class"]: r for r in report.collect()}
    assert {"0", "1", "accuracy", "macro avg", "weighted avg"} == set(report)
    assert report["accuracy"]["support"] == report["0"]["support"] + report["1"]["support"]
