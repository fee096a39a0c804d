"""Monthly author and super chat statistics, and their joins.

A hot author or channel never reaches one task whole: every aggregate is combined before its
shuffle, distinct channels are first reduced to one row per (author, month, channel) spread
over all three keys, and distinct days are bits of a number, which need no distinct at all.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import day_bit, month, period

AUTHOR_MONTH = ["author", "month"]


def author_stats(chat: DataFrame, count: str = "ts") -> DataFrame:
    """Per author and month: chats, days with chats, channels chatted in, text length.

    chat: author, channel, ts, bodylength. ``chats`` counts the non-null values of ``count``.
    ``uniqueChatters`` counts the author's distinct channels; the name is historical.
    """
    return _named_period(_author_months(chat, count))


def member_stats(chat: DataFrame, count: str = "bodylength", fill: bool = False) -> DataFrame:
    """``author_stats`` plus ``uniqueMembers``: distinct channels with member chats.

    An author without any member chat in the month gets NULL, as from a left join of the
    member-only aggregate, or 0 with ``fill``; the chats are read once either way.
    """
    members = F.when(F.col("anyMember"), F.col("uniqueMembers"))
    stats = _author_months(chat, count, members=True)
    stats = stats.withColumn("uniqueMembers", members).drop("anyMember")
    if fill:
        stats = stats.fillna(0, ["uniqueMembers"])
    return _named_period(stats)


def superchat_stats(superchat: DataFrame) -> DataFrame:
    """Per author and month: number of super chats and their mean significance."""
    return _named_period(_superchat_months(superchat))


def combined_stats(chat: DataFrame, superchat: DataFrame, how: str = "inner") -> DataFrame:
    """``author_stats`` joined with ``superchat_stats`` on author and month.

    Both sides leave their aggregation partitioned by the join keys, one row per key, so the
    join adds no shuffle and cannot be skewed.
    """
    return _named_period(
        _author_months(chat, "ts").join(_superchat_months(superchat), AUTHOR_MONTH, how)
    )


def join_stats(chat_stats: DataFrame, superchat_stats: DataFrame, how: str = "inner") -> DataFrame:
    """Join statistics that were written earlier, on author and period."""
    return chat_stats.join(superchat_stats, ["author", "period"], how)


def channel_stats(channels: DataFrame, stats: DataFrame) -> DataFrame:
    """Channel facts in front of each row of monthly channel statistics.

    The join method is left to adaptive execution: it broadcasts the channels only while
    their measured size is below the session's limit, else it shuffles and splits skew.
    """
    return channels.drop("photo").join(stats, "channelId")


def log_targets(stats: DataFrame, column: str = "superchats") -> DataFrame:
    """Add log2 and log10 of a count; NULL where the count is not positive."""
    return stats.withColumns({
        f"log2_{column}": F.log2(_positive(column)), f"log10_{column}": F.log10(_positive(column))
    })


def with_mean(df: DataFrame, column: str, of: DataFrame, name: str = "mean") -> DataFrame:
    """Add to each row the mean of ``column`` over ``of``, as a scalar subquery."""
    return df.withColumn(name, of.agg(F.avg(column).alias(name)).scalar())


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def _author_months(chat: DataFrame, count: str, members: bool = False) -> DataFrame:
    parts = {
        "chats": F.count(count),
        "days": F.bit_or(day_bit(F.col("ts"))),
        "totalBodyLength": F.sum(F.col("bodylength").cast("bigint")),
    }
    wholes = {
        "chats": F.sum("chats"),
        "videoDays": F.coalesce(F.bit_count(F.bit_or("days")), F.lit(0)).cast("bigint"),
        "uniqueChatters": F.count("channel"),
        "totalBodyLength": F.sum("totalBodyLength"),
    }
    if members:
        parts["anyMember"] = F.coalesce(F.max("member"), F.lit(False))
        wholes["uniqueMembers"] = F.count(F.when(F.col("anyMember"), F.col("channel")))
        wholes["anyMember"] = F.max("anyMember")
    per_channel = chat.groupBy("author", month(F.col("ts")).alias("month"), "channel")
    return _aggregate(_aggregate(per_channel, parts).groupBy(*AUTHOR_MONTH), wholes)


def _superchat_months(superchat: DataFrame) -> DataFrame:
    return _aggregate(superchat.groupBy("author", month(F.col("ts")).alias("month")), {
        "superchats": F.count("ts"), "avgSignificance": F.avg("significance"),
    })


def _aggregate(grouped, columns: dict[str, Column]) -> DataFrame:
    return grouped.agg(*(value.alias(name) for name, value in columns.items()))


def _named_period(stats: DataFrame) -> DataFrame:
    rest = [c for c in stats.columns if c not in AUTHOR_MONTH]
    return stats.select("author", period(F.col("month")).alias("period"), *rest)
