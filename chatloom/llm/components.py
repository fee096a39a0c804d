"""Connected components of links between long ids, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import pinned, unpin


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` for the ends of ``links`` (``a``, ``b``): one label a component.

    Each round points every node to the smallest of itself and its neighbours and replaces the
    ends of all links by where they point; links inside one node vanish. When none is left, the
    rounds' pointers are followed one after the other. Minima are taken by partial aggregation
    and the joins have one row a node on one side, so a node with very many links is no hot
    group. Links with a null end count for nothing; repeated links count once; a link from a
    node to itself gives that node. Without links there is no row.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b")
    edges = pinned(both.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "links")
    labels, used = None, []
    while not edges.isEmpty():
        pointers = pinned(
            edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "pointers"
        )
        if labels is None:
            labels = pointers.select("node", F.col("to").alias("component"))
        else:
            labels = (
                labels.join(pointers.select(F.col("node").alias("component"), "to"), "component", "left")
                .select("node", F.coalesce("to", "component").alias("component"))
            )
        used += [edges, pointers]
        edges = pinned(
            edges.join(pointers.toDF("a", "to_a"), "a").join(pointers.toDF("b", "to_b"), "b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(),
            "links",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    components = pinned(labels, "components")
    unpin(edges, *used)
    return components
