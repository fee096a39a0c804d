"""Evaluation: one aggregate per report, no driver loops."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import pinned

SPLITS = {"Train": "train", "Test": "test"}


def error_metrics(label: str, prediction: str, where: Column | None = None) -> dict[str, Column]:
    """Aggregates MSE, RMSE, MAE and r2 of a prediction, over the rows that match ``where``.

    r2 compares with the variance of the label; a constant label gives NULL.
    """
    truth, guess = F.col(label).cast("double"), F.col(prediction).cast("double")
    if where is not None:
        truth, guess = F.when(where, truth), F.when(where, guess)
    error = truth - guess
    mse = F.avg(error * error)
    spread = F.var_pop(F.when(guess.isNotNull(), truth))
    return {
        "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(error)),
        "r2": 1 - mse / F.nullif(spread, F.lit(0.0)),
    }


def regression_metrics(
    predictions: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """n, mse, rmse, mae, r2 in one pass, per group of ``by``."""
    metrics = error_metrics(label, prediction)
    return predictions.groupBy(*(by or [])).agg(
        F.count(F.col(label) - F.col(prediction)).alias("n"),
        *(value.alias(name) for name, value in metrics.items()),
    )


def accuracy(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return predictions.agg(F.count(hit).alias("n"), F.avg(hit).alias("accuracy"))


def classification_report(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Predictions are counted into a confusion table first; all later steps see only its few
    rows. An undefined ratio is 0.
    """
    truth, guess = F.col(label).cast("string"), F.col(prediction).cast("string")
    confusion = predictions.groupBy(truth.alias("truth"), guess.alias("guess")).agg(
        F.count("*").alias("n")
    )
    zero, n = F.lit(0).cast("bigint"), F.col("n")
    hits = F.when(F.col("truth") == F.col("guess"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), n.alias("actual"), zero.alias("chosen"),
                 hits.alias("hits")),
        F.struct(F.col("guess").alias("class"), zero.alias("actual"), n.alias("chosen"),
                 zero.alias("hits")),
    )
    counts = confusion.select(F.inline(sides)).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("chosen").alias("chosen"),
        F.sum("hits").alias("hits"),
    )
    ratios = {
        "precision": _ratio(F.col("hits"), F.col("chosen")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1": _ratio(2 * F.col("hits"), F.col("chosen") + F.col("support")),
    }
    # One rollup gives the classes and, in its total row, all averages over them.
    levels = counts.withColumns(ratios).rollup("class").agg(
        F.grouping("class").alias("total"), F.sum("support").alias("support"),
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *(F.avg(name).alias(name) for name in ratios),
        *(_ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(f"weighted_{name}")
          for name in ratios),
    )

    def line(title, columns):
        values = [F.col(c).alias(name) for name, c in zip(ratios, columns)]
        return F.struct(title.alias("class"), *values, F.col("support"))

    averages = F.array(
        line(F.lit("accuracy"), ["accuracy"] * 3),
        line(F.lit("macro avg"), ratios),
        line(F.lit("weighted avg"), [f"weighted_{name}" for name in ratios]),
    )
    lines = F.when(F.col("total") == 1, averages).otherwise(F.array(line(F.col("class"), ratios)))
    return levels.select(F.inline(lines))


def area_under_roc(
    predictions: DataFrame, label: str = "label", score: str = "score"
) -> DataFrame:
    """``n`` and the exact ``area_under_roc``: the share of (positive, negative) pairs in order.

    Rows are counted by score first; equal scores count half. Running counts are taken inside
    ranges of scores and over the ranges' sums, so no task holds all scores. Without rows of both
    classes the area is NULL.
    """
    positive = F.col(label) == 1
    by_score = predictions.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("hits"), F.count_if(~positive).alias("misses")
    )
    ranged = by_score.repartitionByRange("score").withColumn("_part", F.spark_partition_id())
    ranged = pinned(ranged, "scores")  # part numbers stay as they are
    running = F.sum("misses").over(Window.orderBy("_part")) - F.col("misses")
    parts = ranged.groupBy("_part").agg(F.sum("misses").alias("misses")).select("_part", running.alias("_before"))
    inside = F.sum("misses").over(Window.partitionBy("_part").orderBy("score")) - F.col("misses")
    below = F.col("_before") + F.col("_inside")
    pairs = ranged.withColumn("_inside", inside).join(parts, "_part").select(
        "hits", "misses", (F.col("hits") * (below + F.col("misses") / 2)).alias("ordered")
    )
    total = F.sum("hits") * F.sum("misses")
    return pairs.agg(
        F.coalesce(F.sum(F.col("hits") + F.col("misses")), F.lit(0)).alias("n"),
        (F.sum("ordered") / F.nullif(total, F.lit(0))).alias("area_under_roc"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
