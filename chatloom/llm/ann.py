"""Nearest neighbours by collision counting over single projections.

Each of ``PROJECTIONS`` random directions gives one sorted array of a shard's vectors. A query
opens a window around its own projection in every array and widens all windows by a factor at a
time, which is the same as hashing anew with wider buckets (virtual rehashing). A vector that has
been met in ``SHARE`` of the arrays is verified by its exact distance. At a window of half width
``h``, a vector at distance ``d`` is met in an array with probability 2 Phi(h / d) - 1; so once
the k-th verified distance is small enough against ``h``, a nearer vector that was not met often
enough is unlikely, and the query ends. There is no cap on the vectors verified.

Vectors are dealt to shards and queries to blocks; a task answers one block from one shard, and
the shards' answers are merged by rank.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.workers import group_map
from chatloom.session import pinned

PROJECTIONS = 48
SHARE = 0.6
#: Standard deviations of the number of collisions by which a near vector must be safe.
MARGIN = 1.5
WIDEN = 1.4
SHARD_VECTORS = 8192
BLOCK_QUERIES = 4096
SEED = 17

FOUND = "query_id long, vec_id long, score double"


def _normal_quantile(p: float) -> float:
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (low, mid)
    return low


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, share: float = SHARE):
        self.ids, self.vectors = ids, vectors
        self.directions = np.random.default_rng(SEED).standard_normal((projections, vectors.shape[1]))
        # scaled so that huge and tiny numbers neither overflow nor vanish in a product
        self.scale = float(np.abs(vectors).max()) or 1.0
        projected = (vectors / self.scale) @ self.directions.T
        self.order = np.argsort(projected, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(projected, self.order.T.astype(np.int64), axis=0).T.copy()
        self.needed = max(1, math.ceil(share * projections))
        safe = min(0.999, share + MARGIN * math.sqrt(share * (1 - share) / projections))
        self.reach = _normal_quantile((1 + safe) / 2)
        spread = float(np.median(projected.std(axis=0)))
        self.first_width = 0.2 * spread or 1e-9

    def nearest(self, query_id, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, ties to the smaller id; never ``query_id``."""
        n, m = len(self.ids), len(self.sorted)
        center = self.directions @ (query / self.scale)
        at = np.array([np.searchsorted(row, c) for row, c in zip(self.sorted, center, strict=True)])
        left, right = at.copy(), at.copy()
        met, done = np.zeros(n, np.int64), self.ids == query_id
        best = np.zeros(0, np.int64), np.zeros(0)
        width, target = self.first_width, int((~done).sum())
        verified = 0
        while verified < target:
            new = []
            for row in range(m):
                line, order = self.sorted[row], self.order[row]
                a = np.searchsorted(line, center[row] - width, "left")
                b = np.searchsorted(line, center[row] + width, "right")
                a, b = min(a, left[row]), max(b, right[row])
                new += [order[a:left[row]], order[right[row]:b]]
                left[row], right[row] = a, b
            met += np.bincount(np.concatenate(new), minlength=n)
            if (left == 0).all() and (right == n).all() or not np.isfinite(center + width).all():
                met[:] = m  # nothing is outside the windows, or no window can be said in numbers
            ready = np.flatnonzero((met >= self.needed) & ~done)
            if len(ready):
                done[ready] = True
                verified += len(ready)
                step = self.vectors[ready] - query
                distance = np.sqrt((step * step).sum(axis=1))
                ids, distance = np.concatenate((best[0], self.ids[ready])), np.concatenate((best[1], distance))
                first = np.lexsort((ids, distance))[:k]
                best = ids[first], distance[first]
            if len(best[0]) == k and best[1][-1] * self.reach <= width * self.scale:
                break
            width *= WIDEN
        return best


def _answer(k: int, projections: int, share: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        queries, vectors = rows[rows["asks"]], rows[~rows["asks"]].sort_values("vec_id")
        out = [], [], []
        if len(queries) and len(vectors):
            shard = Shard(vectors["vec_id"].to_numpy(), np.stack(vectors["embedding"].to_list()), projections, share)
            for query_id, query in zip(queries["vec_id"], queries["embedding"], strict=True):
                ids, distances = shard.nearest(query_id, np.asarray(query), k)
                out[0].append(np.full(len(ids), query_id))
                out[1].append(ids)
                out[2].append(distances)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles): not null, not zero, all components finite, ids once.

    Of different vectors that share an id, the smallest stays.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )


def nearest(
    vectors: DataFrame, asks, k: int = 10, projections: int = PROJECTIONS, share: float = SHARE,
    shard_vectors: int = SHARD_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest other vectors found for each vector for which the condition ``asks`` holds.

    ``vectors`` needs ``vec_id`` and ``embedding``; see ``usable`` for rows that take no part.
    Vectors of different length are never compared. ``rank`` counts from 1, ``score`` is the
    Euclidean distance in double precision, ties go to the smaller id. A query with fewer
    candidates gets them all; an empty table gives no row.
    """
    rows = pinned(usable(vectors).withColumn("size", F.size("embedding")).withColumn("asks", asks), "vectors")
    counted = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).head()
    shards, blocks = max(1, -(-counted["n"] // shard_vectors)), max(1, -(-counted["q"] // block_queries))
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    shard, block = (dealt % shards).cast("int"), (F.floor(dealt / F.lit(1 << 20)) % blocks).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("shard", shard).withColumn("block", each(blocks)).withColumn("asks", F.lit(False))
    queries = rows.where("asks").withColumn("block", block).withColumn("shard", each(shards))
    cells = base.unionByName(queries).repartition(shards * blocks, "size", "shard", "block")
    found = group_map(rows.sparkSession, cells.groupBy("size", "shard", "block"), _answer(k, projections, share), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
