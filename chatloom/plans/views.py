"""Chat tables as SQL views, for users who write SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

AUTHOR_STATS = """
SELECT author, substring(month, 1, 7) AS period, chats, videoDays, uniqueChatters, totalBodyLength
FROM (
  SELECT authorChannelId AS author, trunc(to_date(timestamp), 'MM') AS month,
         count(timestamp) AS chats,
         cast(coalesce(bit_count(bit_or(shiftleft(1, dayofmonth(to_date(timestamp)) - 1))), 0)
              AS bigint) AS videoDays,
         count(DISTINCT channelId) AS uniqueChatters, sum(bodylength) AS totalBodyLength
  FROM {chat}
  GROUP BY authorChannelId, trunc(to_date(timestamp), 'MM')
)
"""


def register(chat: DataFrame, superchat: DataFrame, names: tuple[str, str] = ("chat", "superchat")) -> None:
    """Views of both tables, called ``names``, under the column names of the raw files."""
    columns = {"author": "authorChannelId", "channel": "channelId", "ts": "timestamp"}
    chat.withColumnsRenamed(columns).withColumn(
        "isMember", F.col("member").cast("string")
    ).drop("member").createOrReplaceTempView(names[0])
    superchat.withColumnsRenamed(columns).createOrReplaceTempView(names[1])


def author_stats(spark: SparkSession, chat: str = "chat") -> DataFrame:
    """``stats.author_stats`` as SQL over the view: one distinct count, so no Expand."""
    return spark.sql(AUTHOR_STATS.format(chat=chat))
