"""Declared schemas of the text files; counts are long and measures double throughout.

Fixed values: the column names and their order are those of the files.
"""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, type_) for name, type_ in columns.items()])


_TEXT, _LONG, _DOUBLE, _INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

CHAT_STATS = _schema(
    author=_TEXT, period=_TEXT, chats=_LONG, videoDays=_LONG, uniqueChatters=_LONG,
    totalBodyLength=_LONG,
)
SUPERCHAT_STATS = _schema(author=_TEXT, period=_TEXT, superchats=_LONG, avgSignificance=_DOUBLE)
# Superchat statistics in the older form that names no period.
SUPERCHAT_STATS_NO_PERIOD = _schema(author=_TEXT, superchats=_LONG, avgSignificance=_DOUBLE)
COMBINED_STATS = _schema(
    period=_TEXT, chats=_LONG, videoDays=_LONG, uniqueChatters=_LONG, totalBodyLength=_LONG,
    id=_TEXT, superchats=_DOUBLE, avgSignificance=_DOUBLE,
)
CHANNELS = _schema(
    channelId=_TEXT, name=_TEXT, englishName=_TEXT, affiliation=_TEXT, subscriptionCount=_LONG,
    videoCount=_LONG, photo=_TEXT,
)
CHANNEL_CHAT_STATS = _schema(
    channelId=_TEXT, period=_TEXT, chats=_LONG, memberChats=_LONG, uniqueChatters=_LONG,
    uniqueMembers=_LONG, bannedChatters=_LONG, deletedChats=_LONG,
)
CHANNEL_SUPERCHAT_STATS = _schema(
    channelId=_TEXT, period=_TEXT, superChats=_LONG, uniqueSuperChatters=_LONG, totalSC=_LONG,
    averageSC=_LONG, totalMessageLength=_LONG, averageMessageLength=_TEXT,
    mostFrequentCurrency=_TEXT, mostFrequentColor=_TEXT,
)
MESSAGES = _schema(body=_TEXT, label=_TEXT)
REVIEWS = _schema(polarity=_INT, title=_TEXT, text=_TEXT)
SCORES = _schema(**{
    "model": _TEXT, "label_col": _TEXT,
    "Train MSE": _DOUBLE, "Train RMSE": _DOUBLE, "Train MAE": _DOUBLE,
    "Test MSE": _DOUBLE, "Test RMSE": _DOUBLE, "Test MAE": _DOUBLE,
})
