"""Channel time series: one document per channel with a list per measure."""

from pyspark.sql import DataFrame, functions as F

# The columns of a channel and its measures.
CHANNEL_FACTS = ["name", "englishName", "affiliation", "subscriptionCount", "videoCount"]
CHAT_MEASURES = [
    "chats", "memberChats", "uniqueChatters", "uniqueMembers", "bannedChatters", "deletedChats",
]
SUPERCHAT_MEASURES = [
    "superChats", "uniqueSuperChatters", "totalSC", "averageSC", "totalMessageLength",
    "averageMessageLength", "mostFrequentCurrency", "mostFrequentColor",
]


def channel_series(channels: DataFrame, stats: DataFrame, measures: list[str]) -> DataFrame:
    """Nest monthly channel statistics into period-ordered, aligned lists per channel.

    All measures of a month travel in one struct, so a NULL keeps its place and the n-th
    entry of each list belongs to the n-th period. Channel facts are joined after nesting,
    once per channel instead of once per month.

    Every row of the statistics becomes an entry: rows of one month follow one another, ordered
    by their measures.
    """
    entry = F.struct("period", *measures)
    nested = stats.groupBy("channelId").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    lists = [F.col(f"rows.{c}").alias(c) for c in ["period", *measures]]
    return (
        channels.select("channelId", *CHANNEL_FACTS)
        .join(nested, "channelId")
        .select("channelId", *CHANNEL_FACTS, *lists)
    )


def chat_series(channels: DataFrame, stats: DataFrame) -> DataFrame:
    return channel_series(channels, stats, CHAT_MEASURES)


def superchat_series(channels: DataFrame, stats: DataFrame) -> DataFrame:
    return channel_series(channels, stats, SUPERCHAT_MEASURES)
