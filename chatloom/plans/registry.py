"""Named queries: ``(spark, sf_dir) -> DataFrame`` over the driver's whole tables."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import casts, text
from ..operators import embeddings, features, messages, metrics, models, sampling, series, sketches, stats, trees
from ..session import pinned, scratch_path
from ..sources import incremental, inspection, readers, writers
from . import bindings, jobs, views

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Statistics and joins.

@query
def author_stats(spark, sf_dir):
    return stats.author_stats(bindings.chat(spark, sf_dir))


@query
def author_stats_body(spark, sf_dir):
    return stats.author_stats(bindings.chat(spark, sf_dir), count="bodylength")


@query
def author_stats_sql(spark, sf_dir):
    names = ("query_chat", "query_superchat")
    views.register(bindings.chat(spark, sf_dir), bindings.superchat(spark, sf_dir), names)
    return views.author_stats(spark, names[0])


@query
def member_filter_sql(spark, sf_dir):
    """Member chats per author from the view, where membership is text."""
    names = ("query_chat", "query_superchat")
    views.register(bindings.chat(spark, sf_dir), bindings.superchat(spark, sf_dir), names)
    return spark.sql("""
        SELECT authorChannelId AS author, count(*) AS memberChats,
               count(DISTINCT channelId) AS uniqueMembers
        FROM query_chat WHERE isMember = 'true' GROUP BY authorChannelId""")


@query
def superchat_stats(spark, sf_dir):
    return _rounded(stats.superchat_stats(bindings.superchat(spark, sf_dir)), "avgSignificance")


@query
def combined_stats(spark, sf_dir):
    chat, superchat = bindings.chat(spark, sf_dir), bindings.superchat(spark, sf_dir)
    return _rounded(stats.combined_stats(chat, superchat), "avgSignificance")


@query
def combined_stats_right(spark, sf_dir):
    chat = bindings.chat(spark, sf_dir)
    superchat = bindings.ordered_superchat(spark, sf_dir)
    return _rounded(stats.combined_stats(chat, superchat, how="right"), "avgSignificance")


@query
def member_stats(spark, sf_dir):
    return stats.member_stats(bindings.chat(spark, sf_dir))


@query
def member_stats_filled(spark, sf_dir):
    return stats.member_stats(bindings.chat(spark, sf_dir), fill=True)


@query
def channel_stats(spark, sf_dir):
    return stats.channel_stats(
        bindings.channels(spark, sf_dir), bindings.channel_chat_stats(spark, sf_dir)
    )


@query
def channel_stats_superchat(spark, sf_dir):
    return stats.channel_stats(
        bindings.channels(spark, sf_dir), bindings.channel_superchat_stats(spark, sf_dir)
    )


def _lists_as_text(df):
    """Lists written as 'a,b,null' so that both engines print them alike."""
    lists = [name for name, type_ in df.dtypes if type_.startswith("array")]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",", "null") for c in lists})


@query
def channel_series_chat(spark, sf_dir):
    return _lists_as_text(series.chat_series(
        bindings.channels(spark, sf_dir), bindings.channel_chat_stats(spark, sf_dir)
    ))


@query
def channel_series_superchat(spark, sf_dir):
    return _lists_as_text(series.superchat_series(
        bindings.channels(spark, sf_dir), bindings.channel_superchat_stats(spark, sf_dir)
    ))


@query
def channel_series_positions(spark, sf_dir):
    """One row per channel and place in its lists, values in their own types."""
    documents = series.chat_series(
        bindings.channels(spark, sf_dir), bindings.channel_chat_stats(spark, sf_dir)
    )
    entries = F.arrays_zip("period", *series.CHAT_MEASURES)
    return documents.select("channelId", F.posexplode(entries).alias("position", "entry")).select(
        "channelId", "position", "entry.*"
    )


@query
def cast_map(spark, sf_dir):
    raw = bindings.table(spark, sf_dir, "events").select(
        "event_id", F.col("value").cast("decimal(12,2)").cast("string").alias("whole"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("number"),
        F.col("event_type").alias("unreadable"), "event_type",
    )
    return casts.cast_columns(raw, {"whole": "bigint", "number": "double", "unreadable": "bigint"})


@query
def log_target(spark, sf_dir):
    targets = stats.log_targets(stats.superchat_stats(bindings.superchat(spark, sf_dir)))
    return _rounded(targets, "log2_superchats", "log10_superchats").drop("avgSignificance")


# Messages.

@query
def label_from_source(spark, sf_dir):
    return readers.with_label(bindings.flagged_messages(spark, sf_dir))


@query
def union_all(spark, sf_dir):
    chats = bindings.table(spark, sf_dir, "conversations").select(F.col("text").alias("body"))
    documents = bindings.documents(spark, sf_dir).select(F.col("text").alias("body"))
    return chats.unionByName(documents)


@query
def dedup_messages(spark, sf_dir):
    return messages.deduplicate(bindings.documents(spark, sf_dir).select("text", "lang"))


@query
def class_counts(spark, sf_dir):
    return messages.class_counts(bindings.flagged_messages(spark, sf_dir))


@query
def clean_messages(spark, sf_dir):
    cleaned = messages.clean_messages(bindings.word_messages(spark, sf_dir))
    return cleaned.groupBy("body", "label").agg(F.count("*").alias("n"))


@query
def clean_messages_loose(spark, sf_dir):
    rows = bindings.flagged_messages(spark, sf_dir)
    return messages.clean_messages(readers.with_label(rows), strict=False)


@query
def alpha_tokens(spark, sf_dir):
    words = bindings.documents(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("token"))
    return words.where(text.is_alphabetic(F.col("token"))).groupBy("token").agg(
        F.count("*").alias("n")
    )


_EMOJI_TEXT = " \U0001F600\U0001F44D\U0001F3FD! ok❤️ end"


def _emoji_documents(spark, sf_dir):
    return bindings.documents(spark, sf_dir).select(
        "doc_id", F.concat("text", F.lit(_EMOJI_TEXT)).alias("text")
    )


@query
def strip_emoji(spark, sf_dir):
    return _emoji_documents(spark, sf_dir).withColumn("text", text.strip_emoji(F.col("text")))


@query
def drop_emoji_tokens(spark, sf_dir):
    return _emoji_documents(spark, sf_dir).withColumn("text", text.drop_emoji_tokens(F.col("text")))


@query
def remove_punctuation(spark, sf_dir):
    return bindings.documents(spark, sf_dir).select(
        "doc_id", text.remove_punctuation(F.col("text")).alias("text")
    )


@query
def split_sentences(spark, sf_dir):
    return messages.sentences(bindings.documents(spark, sf_dir), "doc_id")


# Tokens. Lists are written as one text, tokens parted by a blank.

@query
def token_document_frequency(spark, sf_dir):
    return features.document_frequency(bindings.documents(spark, sf_dir), text.tokens(F.col("text")))


@query
def term_idf(spark, sf_dir):
    documents = bindings.documents(spark, sf_dir)
    return _rounded(features.term_idf(documents, text.tokens(F.col("text"))), "idf")


@query
def web_token_filter(spark, sf_dir):
    words = text.without_web_tokens(text.tokens(F.col("html")))
    return bindings.pages(spark, sf_dir).select("page_id", F.array_join(words, " ").alias("words"))


@query
def normalize_tokens(spark, sf_dir):
    words = text.letters_only(text.tokens(F.col("html")))
    return bindings.pages(spark, sf_dir).select("page_id", F.array_join(words, " ").alias("words"))


@query
def remove_stopwords(spark, sf_dir):
    words = text.without_stop_words(text.tokens(F.col("text")))
    return bindings.documents(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("words"))


@query
def content_words(spark, sf_dir):
    words = text.content_words(F.col("text"))
    return bindings.documents(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("words"))


# Splits and samples.

@query
def period_split(spark, sf_dir):
    marked = sampling.period_split(pinned(stats.author_stats(bindings.chat(spark, sf_dir)), "author-stats"))
    return marked.groupBy("period", "split").agg(
        F.count("*").alias("n"), F.sum("chats").alias("chats")
    )


@query
def hash_split(spark, sf_dir):
    documents = bindings.documents(spark, sf_dir).select("doc_id", "lang")
    return sampling.hash_split(documents, ["doc_id"], 0.3, 1234)


@query
def hash_split_80_20(spark, sf_dir):
    documents = bindings.documents(spark, sf_dir).select("doc_id", "lang")
    return sampling.hash_split(documents, ["doc_id"], 0.2, 42)


@query
def sample_n(spark, sf_dir):
    return sampling.sample_n(bindings.documents(spark, sf_dir), 200)


def _labelled_ids(spark, sf_dir):
    return bindings.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))


@query
def downsample_majority(spark, sf_dir):
    return sampling.downsample(_labelled_ids(spark, sf_dir), 0, 100)


@query
def upsample_minority(spark, sf_dir):
    return sampling.upsample(_labelled_ids(spark, sf_dir), 1, 500)


@query
def balance_classes(spark, sf_dir):
    return sampling.balance_classes(_labelled_ids(spark, sf_dir), 300)


# Evaluation of fixed rules.

@query
def mean_baseline(spark, sf_dir):
    targets = pinned(stats.log_targets(stats.superchat_stats(bindings.superchat(spark, sf_dir))))
    marked = sampling.period_split(targets).withColumnRenamed(jobs.LABEL, "label")
    predicted = stats.with_mean(marked, "label", marked.where("split = 'train'"), "prediction")
    scores = metrics.regression_metrics(predicted, by=["split"]).drop("r2")
    return _rounded(scores, "mse", "rmse", "mae")


@query
def regression_metrics(spark, sf_dir):
    combined = stats.log_targets(stats.combined_stats(
        bindings.chat(spark, sf_dir), bindings.superchat(spark, sf_dir)
    ))
    rule = combined.select(
        F.col(jobs.LABEL).alias("label"), F.log10(F.col("chats") / 3).alias("prediction")
    )
    return _rounded(metrics.regression_metrics(rule), "mse", "rmse", "mae", "r2")


def _quality_rule(spark, sf_dir):
    """Guess toxic wherever the quality is low."""
    return bindings.table(spark, sf_dir, "labels").select(
        F.col("toxic").alias("label"), (F.col("quality") == 0).cast("int").alias("prediction")
    )


@query
def classification_accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(_quality_rule(spark, sf_dir)), "accuracy")


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(_quality_rule(spark, sf_dir))
    return _rounded(report, "precision", "recall", "f1")


@query
def binary_auc(spark, sf_dir):
    scored = bindings.labelled_documents(spark, sf_dir).select(
        F.col("toxic").cast("double").alias("label"), F.col("n_chars").cast("double").alias("score")
    )
    return _rounded(metrics.area_under_roc(scored), "area_under_roc")


# Features.

@query
def mean_pool_vectors(spark, sf_dir):
    vectors = bindings.table(spark, sf_dir, "embeddings")
    pooled = features.mean_pool(vectors, "label", "embedding")
    return _rounded(pooled.select("label", F.posexplode("vector").alias("i", "mean")), "mean")


@query
def tfidf_features(spark, sf_dir):
    words = jobs.with_words(bindings.documents(spark, sf_dir)).select("doc_id", "words")
    vectors = features.tfidf().fit(words).transform(words)
    return vectors.select("doc_id", F.col("features").cast("string").alias("features"))


@query
def term_tfidf(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return _rounded(features.term_tfidf(bindings.documents(spark, sf_dir), "doc_id", words), "tfidf")


def _places(vectors):
    """Values at six digits, moved off the halves, which means of few tokens often are."""
    places = vectors.select("doc_id", F.posexplode("vector").alias("i", "value"))
    return places.withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query
def doc_vectors(spark, sf_dir):
    return _places(jobs.document_vectors(bindings.documents(spark, sf_dir), ["doc_id"]))


@query
def sentence_vectors(spark, sf_dir):
    return _places(jobs.sentence_vectors(bindings.documents(spark, sf_dir), ["doc_id"]))


@query
def token_associations(spark, sf_dir):
    """How many tokens each token meets beyond chance, and how strongly."""
    words = text.content_words(F.col("text"))
    least = 20
    meetings, names = embeddings.numbered_cooccurrences(bindings.documents(spark, sf_dir), words, min_count=least)
    found = embeddings.positive_pmi(meetings, min_count=least).groupBy("a").agg(
        F.count("*").alias("partners"), F.sum("n").alias("meetings"), F.sum("ppmi").alias("strength")
    )
    return found.join(names, F.col("a") == F.col("id")).select(
        "token", "partners", "meetings", F.round("strength", 4).alias("strength")
    )


@query
def first_annotation(spark, sf_dir):
    """The first token of each text, out of an array of annotations."""
    words = F.transform(text.tokens(F.col("text")), lambda w: F.struct(F.length(w).alias("end"), w.alias("result")))
    return bindings.documents(spark, sf_dir).select("doc_id", casts.first_result(words).alias("first"))


# Models.

def _regression_data(spark, sf_dir):
    return jobs.regression_data(bindings.chat(spark, sf_dir), bindings.superchat(spark, sf_dir))


@query
def assembled_features(spark, sf_dir):
    """The regression table with its feature vector taken apart again."""
    data = _regression_data(spark, sf_dir)
    vector = vector_to_array("features")
    parts = [F.get(vector, F.lit(i)).alias(f"f_{c}") for i, c in enumerate(features.STATS_FEATURES)]
    return _rounded(data.select("author", "period", "split", jobs.LABEL, *parts), jobs.LABEL)


def _register_regressor(name, model, label=jobs.LABEL):
    def run(spark, sf_dir):
        scores = jobs.regression_scores(_regression_data(spark, sf_dir), [model], label)
        return _rounded(scores, *scores.columns[2:])
    QUERIES[name] = run


_register_regressor("model_linear", "linear regression")
_register_regressor("model_glm_gaussian", "glm gaussian")
_register_regressor("model_glm_poisson", "glm poisson")
_register_regressor("model_glm_gamma", "glm gamma", "superchats")
_register_regressor("model_glm_tweedie", "glm tweedie")
_register_regressor("model_random_forest", "rfr")
_register_regressor("model_decision_tree", "dtr")


@query
def model_leaderboard(spark, sf_dir):
    return models.leaderboard(_regression_data(spark, sf_dir), ["superchats", jobs.LABEL])


@query
def tree_expressions(spark, sf_dir):
    """On how many rows the compiled trees and the fitted models predict the very same number."""
    data = _regression_data(spark, sf_dir)
    fitted = jobs.regression_models(data, ["dtr", "rfr"])
    boards = []
    for name, model in fitted.items():
        own = model.transform(data).withColumn("compiled", trees.compiled(model, features.STATS_FEATURES))
        boards.append(own.agg(
            F.lit(name).alias("model"), F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("compiled")).alias("equal"),
            F.countDistinct("prediction").alias("predictions"),
        ).select("model", "n", "equal", (F.col("predictions") > 8).cast("int").alias("varied")))
    return boards[0].unionByName(boards[1])


@query
def model_coefficients(spark, sf_dir):
    data = _regression_data(spark, sf_dir)
    model = models.fit_regressor(models.generalized_linear_regression(jobs.LABEL), data)
    return _rounded(models.coefficients(model, features.STATS_FEATURES), "weight")


@query
def text_classifier(spark, sf_dir):
    return jobs.classify_text(bindings.reviews(spark, sf_dir))


@query
def toxicity_classifier(spark, sf_dir):
    return jobs.classify_toxicity(bindings.labelled_documents(spark, sf_dir))


@query
def vector_classifier(spark, sf_dir):
    return jobs.classify_vectors(bindings.labelled_documents(spark, sf_dir), per_class=500)


@query
def sentence_vector_classifier(spark, sf_dir):
    labelled = bindings.labelled_documents(spark, sf_dir)
    return jobs.classify_vectors(labelled, per_class=500, by_sentence=True)


def _agreement(before, after, keys):
    """How many rows there are, and on how many both predictions agree."""
    both = before.select(*keys, F.col("prediction").alias("before")).join(
        after.select(*keys, F.col("prediction").alias("after")), keys
    )
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("before") == F.col("after")).alias("equal"))


@query
def model_reload(spark, sf_dir):
    """Predictions of a pipeline that was fitted, saved and loaded again."""
    words = jobs.with_words(jobs.binary_labels(bindings.reviews(spark, sf_dir)))
    path = scratch_path(spark, "text-model")
    model = models.text_classifier().fit(words)
    model.write().save(path)
    return _agreement(model.transform(words), PipelineModel.load(path).transform(words), ["doc_id"])


@query
def pipeline_reload(spark, sf_dir):
    """Predictions of a pipeline that was saved unfitted, loaded and then fitted."""
    words = pinned(jobs.with_words(jobs.binary_labels(bindings.reviews(spark, sf_dir))), "words")
    path = scratch_path(spark, "text-pipeline")
    models.text_classifier().write().save(path)
    before, after = models.text_classifier().fit(words), Pipeline.load(path).fit(words)
    return _agreement(before.transform(words), after.transform(words), ["doc_id"])


@query
def saved_regressors(spark, sf_dir):
    """Predictions of regressors that a job saved under their labels, loaded again."""
    data, folder = _regression_data(spark, sf_dir), scratch_path(spark, "regressors")
    names, label = ["linear regression", "glm gaussian", "dtr"], jobs.LABEL
    fitted = jobs.regression_models(data, names, label, folder)
    out = None
    for name in names:
        loaded = models.load_regressor(folder, label, name)
        rows = _agreement(fitted[name].transform(data), loaded.transform(data), ["author", "period"])
        rows = rows.select(F.lit(name).alias("model"), "n", "equal")
        out = rows if out is None else out.unionByName(rows)
    return out


# Files.

@query
def source_select(spark, sf_dir):
    """Rows of every table whose name starts with l, but for labels."""
    chosen = readers.read_named(spark, sf_dir, "l", exclude=["label"])
    return chosen.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query
def csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "chat-stats")
    writers.replace_csv(stats.author_stats(bindings.chat(spark, sf_dir)), path)
    return readers.read_csv(spark, path, schemas.CHAT_STATS)


@query
def csv_header_cast(spark, sf_dir):
    path = scratch_path(spark, "channel-stats")
    writers.replace_csv(bindings.channel_chat_stats(spark, sf_dir), path, header=True)
    types = {c: "bigint" for c in series.CHAT_MEASURES}
    return readers.read_text_columns(spark, path, types)


@query
def csv_reviews(spark, sf_dir):
    """Whole texts, with their quotes, commas and line breaks, through a CSV file and back."""
    path = scratch_path(spark, "reviews")
    rows = bindings.reviews(spark, sf_dir).select(F.col("polarity").cast("int"), "title", "text")
    writers.replace_csv(rows, path, records_per_file=10_000)
    return readers.read_csv(spark, path, schemas.REVIEWS, multiline=True)


@query
def header_csv_typed(spark, sf_dir):
    path = scratch_path(spark, "channel-stats")
    writers.replace_csv(bindings.channel_chat_stats(spark, sf_dir), path, header=True)
    return readers.read_header_csv(spark, path, schemas.CHANNEL_CHAT_STATS)


@query
def messages_csv(spark, sf_dir):
    path = scratch_path(spark, "messages")
    rows = bindings.flagged_messages(spark, sf_dir).select("body", "label")
    writers.replace_csv(rows, path, header=True, records_per_file=10_000)
    return readers.read_csv(spark, path, schemas.MESSAGES, header=True, multiline=True)


@query
def labelled_files(spark, sf_dir):
    """Messages from a file of non-flagged and a file of flagged ones."""
    path, rows = scratch_path(spark, "messages"), bindings.flagged_messages(spark, sf_dir)
    for name in ("nonflagged", "flagged"):
        writers.replace(rows.where(F.col("label") == name).drop("label"), f"{path}/{name}")
    return readers.read_labelled(spark, f"{path}/nonflagged", f"{path}/flagged")


@query
def combined_positional(spark, sf_dir):
    """Combined statistics through a headerless file whose columns are known by position."""
    path = scratch_path(spark, "combined")
    rows = combined_stats(spark, sf_dir).withColumnRenamed("author", "id")
    writers.replace_csv(rows.select(*schemas.COMBINED_STATS.names), path)
    return readers.read_combined(spark, path)


@query
def numbered_files(spark, sf_dir):
    """Yearly statistics in files that carry a number, super chat files two numbers behind."""
    stem = scratch_path(spark, "numbered")
    year = F.year("ts").cast("string")
    chat = pinned(bindings.chat(spark, sf_dir).groupBy("author", year.alias("period")).agg(
        F.count("ts").alias("chats"), F.countDistinct(F.to_date("ts")).alias("videoDays"),
        F.countDistinct("channel").alias("uniqueChatters"),
        F.sum("bodylength").cast("bigint").alias("totalBodyLength"),
    ), "yearly")
    superchat = pinned(bindings.superchat(spark, sf_dir).groupBy("author", year.alias("period")).agg(
        F.count("ts").alias("superchats"), F.round(F.avg("significance"), 6).alias("avgSignificance")
    ), "yearly")
    years = sorted(r["period"] for r in chat.select("period").distinct().collect())
    for number, one in enumerate(years, 2):
        here = F.col("period") == one
        writers.replace_csv(chat.where(here), f"{stem}/chat{number}.csv")
        writers.replace_csv(superchat.where(here).drop("period"), f"{stem}/superchat{number - 2}.csv")
    return jobs.combine_numbered(spark, f"{stem}/chat", f"{stem}/superchat", range(2, 2 + len(years)))


@query
def split_files(spark, sf_dir):
    """Train and test rows of a split, each written to its own file and read back."""
    rows = hash_split(spark, sf_dir)
    parts = []
    for path, side in zip(writers.write_split(rows, scratch_path(spark, "split")), ("train", "test")):
        parts.append(readers.read_text_columns(spark, path, {"doc_id": "bigint"}).withColumn("split", F.lit(side)))
    return parts[0].unionByName(parts[1])


@query
def predictions_json(spark, sf_dir):
    """Label and prediction of a rule, without the vector beside them, as JSON."""
    path = scratch_path(spark, "predictions")
    vectors = features.vector_column(
        _quality_rule(spark, sf_dir).withColumn("rawPrediction", F.array(F.lit(0.0))), "rawPrediction", "rawPrediction"
    )
    writers.write_predictions(vectors, path, ["label", "prediction"])
    return spark.read.schema("label int, prediction int").json(path)


@query
def score_documents(spark, sf_dir):
    """The baseline's scores written once as documents; a second write changes nothing."""
    path = scratch_path(spark, "scores")
    targets = pinned(stats.log_targets(stats.superchat_stats(bindings.superchat(spark, sf_dir))), "targets")
    scores = models.score_regressors({}, sampling.period_split(targets), jobs.LABEL, baseline=True)
    writers.write_once(_rounded(scores, *schemas.SCORES.names[2:]), path)
    writers.write_once(scores.limit(0), path)
    return spark.read.schema(schemas.SCORES).json(path)


@query
def json_documents(spark, sf_dir):
    """Channel documents with their lists, written once; a second write changes nothing."""
    path = scratch_path(spark, "chat-documents")
    documents = series.chat_series(
        bindings.channels(spark, sf_dir), bindings.channel_chat_stats(spark, sf_dir)
    )
    writers.write_once(documents, path)
    writers.write_once(documents.select("channelId"), path)
    return _lists_as_text(spark.read.schema(documents.schema).json(path))


@query
def materialized_stats(spark, sf_dir):
    """Combined statistics by period, computed once and then read from the stored table."""
    path, rows = scratch_path(spark, "combined-stats"), combined_stats(spark, sf_dir)
    for _ in range(2):
        table = writers.materialize(spark, path, lambda: rows, ["period"], rows.schema)
    return table


@query
def incremental_periods(spark, sf_dir):
    """Author statistics kept up to date by source year: one year comes later, another is replaced.

    ``rebuilt`` tells rows in files that the first run had not written.
    """
    chat = bindings.chat(spark, sf_dir).withColumn("year", F.year("ts"))
    folder, path = scratch_path(spark, "yearly-chats"), scratch_path(spark, "yearly-stats")
    schema = stats.author_stats(chat).schema
    columns = [f for f in chat.schema.fields if f.name != "year"]

    def add(rows):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(folder)

    def build(paths):
        return stats.author_stats(spark.read.schema(StructType(columns)).parquet(*paths))

    def refresh():
        listed = incremental.source_files(spark, folder, "year=", r"(\d{4})")
        return incremental.refresh(spark, listed, path, build)

    def table():
        return incremental.read_refreshed(spark, path, schema)

    add(chat.where((F.col("year") != 1998) & ((F.col("year") != 1995) | F.col("member"))))
    refresh()
    name = F.col("_metadata.file_name")
    first = pinned(table().select(name.alias("file")).distinct().withColumn("old", F.lit(True)), "first-files")
    add(chat.where(F.col("year").isin(1995, 1998)))
    refresh()
    rows = table().withColumn("file", name).join(first, "file", "left")
    return rows.withColumn("rebuilt", F.col("old").isNull().cast("int")).drop("file", "old")


@query
def merged_channel_sketches(spark, sf_dir):
    """Yearly statistics from monthly sketches beside exact counts of the same years.

    ``within`` is 1 where the estimate keeps the stated bound, ``exact`` where small counts are met.
    """
    chat = bindings.chat(spark, sf_dir)
    year = F.substring("period", 1, 4)
    merged = sketches.merged_stats(pinned(sketches.monthly_sketches(chat), "sketches"), year, "year")
    channels = chat.groupBy("author", F.year("ts").cast("string").alias("year"), "channel").agg(F.count("*").alias("n"))
    true = channels.groupBy("author", "year").agg(F.count("channel").alias("channels"))
    error = F.abs(F.col("uniqueChatters") - F.col("channels"))
    small = F.col("channels") <= sketches.EXACT
    return merged.join(true, ["author", "year"]).select(
        "author", "year", "chats", "videoDays", "totalBodyLength", "channels",
        (error <= sketches.RELATIVE_ERROR * F.col("channels")).cast("int").alias("within"),
        F.when(small, (error == 0).cast("int")).otherwise(1).alias("exact"),
    )


@query
def inferred_header_csv(spark, sf_dir):
    """Types of a CSV file of order lines from its text alone, and what the declared file then holds."""
    path = scratch_path(spark, "order-lines")
    writers.replace_csv(bindings.table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate")), path, header=True)
    types = pinned(inspection.infer_header_csv(spark, path), "types")
    lines = spark.read.schema(inspection.declared(types)).option("header", True).csv(path)
    held = lines.agg(F.sum("l_orderkey").alias("keys"), F.countDistinct("l_shipdate").alias("days"))
    return types.where(F.col("column").isin("l_orderkey", "l_quantity", "l_shipdate", "l_returnflag")).select(
        "column", "type", "present", held.select("keys").scalar().alias("keys"), held.select("days").scalar().alias("days"))


@query
def quarantined_csv(spark, sf_dir):
    """Channel statistics with a damaged line for each tenth number of chats: what is read and what is kept aside."""
    stats = bindings.channel_chat_stats(spark, sf_dir).select(*schemas.CHANNEL_CHAT_STATS.names)
    damaged = F.when(F.col("chats") % 10 == 0, F.concat(F.lit("~"), F.col("chats"))).otherwise(F.col("chats").cast("string"))
    lines = stats.withColumn("chats", damaged).select(F.concat_ws(",", *stats.columns).alias("value"))
    path = scratch_path(spark, "damaged-lines")
    lines.write.text(path)
    good, bad = inspection.read_checked_csv(spark, path, schemas.CHANNEL_CHAT_STATS)
    bad = pinned(bad, "bad-rows").select(F.split("record", ",")[1].alias("period"), F.lit(1).alias("bad"), F.lit(None).cast("bigint").alias("chats"))
    rows = good.select("period", F.lit(0).alias("bad"), "chats").unionByName(bad)
    return rows.groupBy("period").agg(F.count("chats").alias("n"), F.sum("chats").alias("chats"), F.sum("bad").alias("bad"))
