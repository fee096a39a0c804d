"""Whole analyses: statistics to regression scores, text to classifier scores."""

from collections.abc import Sequence

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import content_words, sentences
from ..operators import features, metrics, models, sampling, series, stats
from ..operators.messages import clean_messages
from ..session import pinned, unpin
from ..sources import readers, writers

LABEL = "log10_superchats"


def regression_table(
    combined: DataFrame, marks: DataFrame | None = None, seed: int = 42
) -> DataFrame:
    """Combined statistics with log targets, held-out months and assembled features.

    The combined table is pinned, since its months are marked (unless ``marks`` are given) and
    every fit reads it many times; the few marks are joined on each read. Messages of which no
    length is known count no letters; any other NULL among the features is an error.
    """
    combined = pinned(stats.log_targets(combined).fillna(0, ["totalBodyLength"]), "combined")
    if marks is None:
        marks = sampling.period_marks(combined, seed=seed)
    return features.assemble(sampling.period_split(combined, marks))


def regression_data(chat: DataFrame, superchat: DataFrame, seed: int = 42) -> DataFrame:
    """``regression_table`` from chats; months are held out among those of the combined table."""
    return regression_table(stats.combined_stats(chat, superchat), seed=seed)


def regression_models(
    data: DataFrame, names: Sequence[str], label: str = LABEL, folder: str | None = None
) -> dict[str, Model]:
    """The named regressors, fitted on the training months; saved under ``folder``/label/name."""
    estimators = models.regressors(label)
    fitted = {name: models.fit_regressor(estimators[name], data) for name in names}
    if folder:
        for name, model in fitted.items():
            model.write().save(models.model_path(folder, label, name))
    return fitted


def regression_scores(
    data: DataFrame, names: Sequence[str], label: str = LABEL, folder: str | None = None
) -> DataFrame:
    """Fit the named regressors on the training months and score them on both parts."""
    return models.score_regressors(regression_models(data, names, label, folder), data, label)


def binary_labels(reviews: DataFrame) -> DataFrame:
    """Polarity 1/2 as label 0/1: a classifier would take 1/2 for three classes."""
    return reviews.withColumn("label", F.col("polarity") - 1)


def with_words(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("words", content_words(F.col(column)))


def _classifier_scores(predictions: DataFrame, label: str, train: DataFrame) -> DataFrame:
    scored = pinned(predictions.select(label, vector_to_array("rawPrediction")[1].alias("score"), "prediction"))
    area, scores = metrics.area_under_roc(scored, label, "score"), metrics.accuracy(scored, label)
    rows = train.agg(F.count("*").alias("train_rows")).withColumn("_one", F.lit(1))
    return (
        rows.join(area.select("area_under_roc", F.lit(1).alias("_one")), "_one")
        .join(scores.select(F.col("n").alias("test_rows"), "accuracy", F.lit(1).alias("_one")), "_one")
        .select("train_rows", "test_rows", "area_under_roc", "accuracy")
    )


def _term_counts(
    df: DataFrame, label: str, key: Sequence[str], test: float, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with their label and sparse term counts, counted once and stored."""
    counted = features.term_frequency().transform(with_words(df)).select(*key, label, "termCounts")
    data = pinned(sampling.hash_split(counted, key, test, seed), "term-counts")
    return data.where("split = 'train'"), data.where("split = 'test'")


def _classify(pipeline, rows: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    train, test = _term_counts(rows, label, key, 0.3, seed)
    stages = pipeline.getStages()[1:]  # the terms are counted already
    fitted = []
    for stage in stages:
        fitted.append(stage.fit(train))
        train = fitted[-1].transform(train) if stage is not stages[-1] else train
    return _classifier_scores(PipelineModel(fitted).transform(test), label, train)


def classify_text(
    reviews: DataFrame, key: Sequence[str] = ("doc_id",), seed: int = 1234
) -> DataFrame:
    """Polarity from text: a 70/30 split, TF-IDF, logistic regression, AUC and accuracy."""
    return _classify(models.text_classifier(), binary_labels(reviews), "label", key, seed)


def classify_toxicity(
    documents: DataFrame, key: Sequence[str] = ("doc_id",), seed: int = 1234
) -> DataFrame:
    """The label ``toxic`` from text, by ridge-regularised logistic regression over TF-IDF."""
    return _classify(models.toxicity_classifier(), documents, "toxic", key, seed)


def document_vectors(
    documents: DataFrame, key: Sequence[str], size: int = 64, column: str = "text"
) -> DataFrame:
    """``key`` and ``vector``, the mean vector of the words of each text.

    ``key`` must identify rows.
    """
    return features.hashed_vectors(with_words(documents, column), key, "words", size)


def sentence_vectors(
    documents: DataFrame, key: Sequence[str], size: int = 64, column: str = "text"
) -> DataFrame:
    """``key`` and ``vector``, the mean over the sentences of a text of each sentence's vector.

    ``key`` must identify rows. A text without any sentence gets a zero vector.
    """
    keys = list(key)
    # a key that repeats is rare: only its rows are put together, sentence by sentence
    repeated = pinned(
        documents.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*keys), "repeated"
    )
    split = F.transform(sentences(F.col(column)), content_words)
    alone = documents.join(repeated, keys, "left_anti").dropna(subset=keys).select(*keys, split.alias("_sentences"))
    found = features.hashed_list_vectors(alone, keys, "_sentences", size)

    again = documents.join(repeated, keys, "left_semi").select(*keys, column)
    parts = again.select(*keys, F.posexplode(sentences(F.col(column))).alias("position", "sentence"))
    each = features.hashed_vectors(with_words(parts, "sentence"), [*keys, "position"], "words", size)
    zero = F.array_repeat(F.lit(0.0), size)
    pooled = again.select(*keys).join(features.mean_pool(each, keys, "vector"), keys, "left")
    missing = F.lit(False)
    for name in keys:
        missing |= F.col(name).isNull()
    without_key = documents.where(missing).select(*keys, zero.alias("vector"))
    return found.unionAll(pooled.select(*keys, F.coalesce("vector", zero).alias("vector"))).unionAll(without_key)


def classify_vectors(
    messages: DataFrame,
    per_class: int,
    size: int = 64,
    key: Sequence[str] = ("doc_id",),
    by_sentence: bool = False,
) -> DataFrame:
    """Toxic or not from text vectors: 80/20 split, balanced training rows, a small network.

    ``per_class`` training rows of each class are learned from, whatever the size of the table;
    the test rows are all others of the split. Keys are balanced first and only the chosen
    texts are embedded, whole or sentence by sentence. Balancing follows the split, so no test
    message is among the copies trained on. Gives a classification report.
    """
    split = sampling.hash_split(messages.select(*key, "toxic", "text"), key, 0.2, 42)
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    embed = sentence_vectors if by_sentence else document_vectors
    chosen = pinned(sampling.balance_classes(train.select(*key, "toxic"), per_class, label="toxic"), "balanced")

    def embedded(rows, labels):
        vectors = features.vector_column(embed(rows, key, size), "vector")
        return labels.join(vectors, list(key)).select("toxic", "features")

    texts = train.join(chosen.select(*key).distinct(), list(key), "left_semi")
    balanced = pinned(embedded(texts, chosen), "balanced-vectors")
    model = models.vector_classifier(size, 2, label="toxic").fit(balanced)
    predictions = model.transform(embedded(test, test.select(*key, "toxic")))
    return metrics.classification_report(
        predictions.select("toxic", F.col("prediction").cast("int").alias("prediction")), "toxic"
    )


def write_samples(
    messages: DataFrame,
    folder: str,
    sizes: Sequence[int] = (20_000, 50_000, 100_000),
    seed: int = 42,
) -> list[str]:
    """Clean labelled messages once and write a CSV sample of each size; gives their paths."""
    cleaned = pinned(clean_messages(messages), "messages")
    paths = []
    for n in sizes:
        paths.append(f"{folder.rstrip('/')}/sample_{n}")
        writers.replace_csv(sampling.sample_n(cleaned, n, seed), paths[-1], header=True)
    unpin(cleaned)
    return paths


def channel_documents(
    spark: SparkSession, channels: str, chat_stats: str, superchat_stats: str
) -> tuple[DataFrame, DataFrame]:
    """Chat and super chat documents per channel from header CSV files, ready for ``write_once``."""
    facts = readers.read_header_csv(spark, channels, schemas.CHANNELS)
    chat = readers.read_header_csv(spark, chat_stats, schemas.CHANNEL_CHAT_STATS)
    superchat = readers.read_header_csv(spark, superchat_stats, schemas.CHANNEL_SUPERCHAT_STATS)
    return series.chat_series(facts, chat), series.superchat_series(facts, superchat)


def combine_numbered(
    spark: SparkSession, chat_stem: str, superchat_stem: str, numbers: Sequence[int], shift: int = 2
) -> DataFrame:
    """Combine statistics files that carry a month number in their name and no period inside.

    Super chats began ``shift`` months later, so chat file i belongs to super chat file
    i - shift. All months are read and joined at once.
    """
    chat = readers.read_numbered(spark, chat_stem, numbers, schemas.CHAT_STATS)
    superchat = readers.read_numbered(
        spark, superchat_stem, [n - shift for n in numbers], schemas.SUPERCHAT_STATS_NO_PERIOD
    ).withColumn("number", F.col("number") + shift)
    return chat.join(superchat, ["author", "number"]).drop("number")
