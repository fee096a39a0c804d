"""Repeatable splits and exact-size samples.

The order of a sample comes from hashes of the rows' own content, never from partitions, arrival
or ``rand()``: equal rows are counted first, and the i-th copy of a row has the hash of (row, i).
So hashes are unique and even, whatever repeats in the table; a sample is the same under any
partitioning, and a smaller sample of a table is part of a larger one.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import below_fraction, content_hash, leading_number, row_hash
from ..session import pinned

DIGITS = 4  # hex digits looked at in one pass of a selection
ROWS_A_BUCKET = 1_000_000


def hash_split(
    df: DataFrame, key: Sequence[str], test_fraction: float, seed: int, name: str = "split"
) -> DataFrame:
    """Mark each row 'train' or 'test'; a key always lands on the same side."""
    test = below_fraction(row_hash(key, seed), test_fraction)
    return df.withColumn(name, F.when(test, "test").otherwise("train"))


def _copies(df: DataFrame) -> DataFrame:
    """Each distinct row of ``df`` as its hash ``_row``, and how many copies there are."""
    return pinned(
        df.select(content_hash(df).alias("_row")).groupBy("_row").agg(F.count("*").alias("_copies")),
        "copies",
    )


def _ordered(copies: DataFrame, seed: int) -> DataFrame:
    """Every copy of every row with its place in the order, the hash ``_order``."""
    each = copies.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_copy"))
    return each.withColumn("_order", F.md5(F.concat_ws("|", "_row", "_copy", F.lit(str(seed)))))


def cut(ordered: DataFrame, n: int, order: str = "_order") -> str | None:
    """The n-th smallest hash; None where there are fewer than n rows.

    Found digit by digit: each pass counts the rows by their next four hex digits, at most
    65,536 counts, and goes on inside the one group that holds the n-th row. The number of
    passes follows the number of rows.
    """
    before, left = "", n
    while True:
        group = F.substring(order, 1, len(before) + DIGITS).alias("digits")
        sizes = ordered.where(F.col(order).startswith(before)).groupBy(group).agg(
            F.count("*").alias("rows"), F.min(order).alias("low"), F.max(order).alias("high")
        )
        upto = sizes.withColumn("upto", F.sum("rows").over(Window.orderBy("digits")))
        found = upto.where(F.col("upto") >= left).orderBy("digits").limit(1).collect()
        if not found:
            return None
        group = found[0]
        if group["low"] == group["high"] or group["upto"] == left:
            return group["high"]
        before, left = group["digits"], left - (group["upto"] - group["rows"])


def period_marks(
    df: DataFrame,
    held_out: int = 5,
    out_of: int = 16,
    seed: int = 42,
    period: str = "period",
    name: str = "split",
) -> DataFrame:
    """Mark the periods of ``df``: 'test' for ``held_out`` of every ``out_of``, picked by hash.

    Any distinct value is a period, however it is written; a missing one is not marked.
    """
    periods = df.select(period).where(F.col(period).isNotNull()).distinct()
    marks = pinned(periods.withColumn("_order", row_hash([period], seed)), "periods")
    held = marks.count() * held_out // out_of
    last = cut(marks, held) if held else None
    test = F.col("_order") <= last if last else F.lit(False)
    return marks.select(period, F.when(test, "test").otherwise("train").alias(name))


def period_split(
    df: DataFrame,
    marks: DataFrame | None = None,
    period: str = "period",
    name: str = "split",
    **choice,
) -> DataFrame:
    """Hold out whole periods, as marked by ``marks`` or by ``period_marks`` of ``df`` itself.

    Give ``marks`` where ``df`` is costly to compute twice. Rows without a mark are train.
    """
    if marks is None:
        marks = period_marks(df, period=period, name=name, **choice)
    return df.join(marks, period, "left").fillna("train", [name])


def _repeated(df: DataFrame, chosen: DataFrame, times: str) -> DataFrame:
    """Each row of ``df`` whose hash is in ``chosen``, as often as ``times`` says."""
    rows = df.withColumn("_row", content_hash(df)).join(chosen, "_row").dropDuplicates(["_row"])
    return rows.withColumn("_time", F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*_names(df))


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{name}`") for name in df.columns]


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement; all rows where the input has no more than n."""
    if n <= 0:
        return df.limit(0)
    ordered = _ordered(_copies(df), seed)
    last = cut(ordered, n)
    if last is None:
        return df
    kept = ordered.where(F.col("_order") <= last).groupBy("_row").agg(F.count("*").alias("_times"))
    return _repeated(df, kept, "_times")


def resample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows with replacement: n draws of a place in the order, joined with the rows.

    Places are found by bucket, a bucket being the rows whose hashes begin alike: draws are dealt
    to buckets by the buckets' sizes, and only the buckets that were drawn are ranked, on hashes
    alone. An empty input gives no rows.
    """
    copies = _copies(df)
    total = copies.agg(F.sum("_copies").alias("n")).head()["n"] or 0
    if not total or n <= 0:
        return df.limit(0)
    digits = max(1, math.ceil(math.log(total / ROWS_A_BUCKET, 16))) if total > ROWS_A_BUCKET else 1
    ordered = _ordered(copies, seed).withColumn("_bucket", F.substring("_order", 1, digits))
    sizes = ordered.groupBy("_bucket").agg(F.count("*").alias("_size"))
    start = F.sum("_size").over(Window.orderBy("_bucket")) - F.col("_size")
    # A stretch of places is one bucket's mean size long, so it meets about two buckets.
    stretch = F.lit(max(1, total // 16 ** digits)).cast("bigint")
    whole = lambda place: F.floor(place / stretch).cast("bigint")
    buckets = pinned(sizes.withColumn("_start", start), "buckets")
    last = F.col("_start") + F.col("_size") - 1
    stretches = buckets.withColumn("_stretch", F.explode(F.sequence(whole(F.col("_start")), whole(last))))
    point = leading_number(F.md5(F.concat_ws("|", F.col("id"), F.lit("draw"), F.lit(seed))), 15)
    draws = df.sparkSession.range(n).select((point % total).alias("_place"))
    inside = (F.col("_place") >= F.col("_start")) & (F.col("_place") <= last)
    drawn = (
        draws.withColumn("_stretch", whole(F.col("_place"))).join(stretches, "_stretch").where(inside)
        .groupBy("_bucket", (F.col("_place") - F.col("_start")).alias("_rank")).agg(F.count("*").alias("_times"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order")).cast("bigint") - 1
    ranked = ordered.join(drawn.select("_bucket").distinct(), "_bucket", "left_semi").withColumn("_rank", rank)
    chosen = ranked.join(drawn, ["_bucket", "_rank"]).groupBy("_row").agg(F.sum("_times").alias("_times"))
    return _repeated(df, chosen, "_times")


def downsample(df: DataFrame, majority, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """n rows of the majority class, without replacement."""
    return sample_n(df.where(F.col(label) == majority), n, seed)


def upsample(df: DataFrame, minority, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """n rows of the minority class, with replacement."""
    return resample_n(df.where(F.col(label) == minority), n, seed)


def balance_classes(
    df: DataFrame, n: int, majority=0, minority=1, label: str = "label", seed: int = 42
) -> DataFrame:
    """n rows of each class. Split first and balance the training part only: copies made
    before a split would put the same message on both sides."""
    return downsample(df, majority, n, label, seed).unionByName(upsample(df, minority, n, label, seed))
