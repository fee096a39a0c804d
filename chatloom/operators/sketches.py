"""Distinct channels of authors over any stretch of months, from monthly sketches.

A monthly table keeps, for each author, what merges without the chats: counts, days, letters, and a
sketch of the channels. A year then reads twelve small rows an author in place of a year of chats.
Days of different months differ, so their numbers add up; channels recur, so their sketches are
united. Sketches are estimates: see ``RELATIVE_ERROR``.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import day_bit, month, period

#: Registers of a sketch as a power of two: 2 KB for each author and month at most, far less for small sets.
LOG_REGISTERS = 12
#: Three standard errors (0.0163 each for 4,096 registers): 99.7 % of the estimates are as near as that.
RELATIVE_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Up to so many channels a sketch holds the hashes themselves and its rounded estimate is their number.
EXACT = 100


def monthly_sketches(chat: DataFrame, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """Per author and month: chats, days with chats, text length, and a sketch of the channels.

    chat: author, channel, ts, bodylength. Sketches are made before the shuffle and united after
    it, so an author with a third of all chats is a few rows by then. A null channel is not counted.
    """
    sketch = F.hll_sketch_agg(F.col("channel").cast("string"), log_registers)
    months = chat.groupBy("author", month(F.col("ts")).alias("month")).agg(
        F.count("ts").alias("chats"),
        F.coalesce(F.bit_count(F.bit_or(day_bit(F.col("ts")))), F.lit(0)).cast("bigint").alias("videoDays"),
        F.sum(F.col("bodylength").cast("bigint")).alias("totalBodyLength"), sketch.alias("channels"),
    )
    rest = [c for c in months.columns if c not in ("author", "month")]
    return months.select("author", period(F.col("month")).alias("period"), *rest)


def merged_stats(sketches: DataFrame, over: Column, name: str = "span") -> DataFrame:
    """``author_stats`` over stretches of months: ``over`` says to which stretch a ``period`` belongs.

    ``uniqueChatters`` is the estimated number of distinct channels; see ``RELATIVE_ERROR`` and
    ``EXACT``. A stretch that is null is one like any other.
    """
    return sketches.groupBy("author", over.alias(name)).agg(
        F.sum("chats").alias("chats"), F.sum("videoDays").alias("videoDays"),
        F.hll_sketch_estimate(F.hll_union_agg("channels")).alias("uniqueChatters"),
        F.sum("totalBodyLength").alias("totalBodyLength"),
    )
