"""Fitted regression trees as tables of nodes, and as expressions.

A stored tree model is a table of nodes. Compiled to nested CASE expressions it predicts from plain
columns: in generated code, without a vector column and without the model's own code, so statistics
can be scored where they are stored and only the four columns of a split are read.
"""

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

NODES = ("tree", "node", "feature", "threshold", "categories", "left", "right", "prediction")


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the tree or forest that was saved at ``path``, see ``NODES``.

    A leaf has no ``left``. An inner node sends a value up to ``threshold``, or one of
    ``categories``, to ``left`` and every other one to ``right``. All trees of a forest weigh the same.
    """
    data = spark.read.parquet(f"{path.rstrip('/')}/data")
    forest = "treeID" in data.columns
    nodes = data.select("treeID", "nodeData.*") if forest else data.withColumn("treeID", F.lit(0))
    inner, ordered = F.col("leftChild") >= 0, F.col("split.numCategories") < 0
    values = F.col("split.leftCategoriesOrThreshold")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ordered, F.get(values, F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, values).alias("categories"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        "prediction",
    )


def prediction(nodes: DataFrame, columns: Sequence[str]) -> Column:
    """The mean prediction of the trees of ``nodes`` from numeric ``columns``, in the features' order.

    The nodes pass through the driver: their number is bounded by the depth and number of trees. A NULL
    or NaN among the columns gives NULL, as no side of a split is its own.
    """
    by_tree: dict[int, dict] = {}
    for row in nodes.collect():
        by_tree.setdefault(row["tree"], {})[row["node"]] = row
    names = [f"cast(`{c.replace('`', '``')}` AS double)" for c in columns]

    def below(tree: dict, node: int) -> str:
        row = tree[node]
        if row["left"] is None:
            return f"{row['prediction']!r}D"
        value = names[row["feature"]]
        if row["threshold"] is None:
            to_left = f"{value} IN ({', '.join(f'{c!r}D' for c in row['categories'])})"
        else:
            to_left = f"{value} <= {row['threshold']!r}D"
        return f"if({to_left}, {below(tree, row['left'])}, {below(tree, row['right'])})"

    each = ", ".join(below(tree, 0) for _, tree in sorted(by_tree.items()))
    # summing a list keeps each tree in a function of its own; one of all trees is too large to compile
    total = f"aggregate(array({each}), 0D, (total, one) -> total + one) / {float(len(by_tree))!r}D"
    known = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names)
    return F.expr(f"if({known}, {total}, NULL)")


def compiled(model: Model, columns: Sequence[str]) -> Column:
    """``prediction`` of a fitted model, by way of its stored nodes in the shared folder."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    return prediction(node_table(spark, path), columns)
