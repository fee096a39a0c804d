"""The test tables under chat names; stand-ins for statistics that arrive ready-made."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def chat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("channel"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_quantity") % 10 != 0, F.col("l_quantity").cast("int")).alias("bodylength"),
        (F.col("l_linestatus") == "F").alias("member"),
    )


def superchat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("ts"),
        (F.col("l_discount") * 100).alias("significance"),
    )


def ordered_superchat(spark, sf_dir) -> DataFrame:
    """Super chats at the time of the order: an author may have no chats in that month."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.where(F.col("l_returnflag") == "R").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_suppkey").alias("author"), F.col("o_orderdate").alias("ts"),
        (F.col("l_discount") * 100).alias("significance"),
    )


def channels(spark, sf_dir) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("channelId"), F.col("s_name").alias("name"),
        F.col("s_name").alias("englishName"), F.col("n_name").alias("affiliation"),
        F.floor("s_acctbal").cast("int").alias("subscriptionCount"),
        F.lit(0).alias("videoCount"), F.lit("").alias("photo"),
    )


def _channel_month_chatter(spark, sf_dir, rows) -> DataFrame:
    """Lineitem per (channel, month, chatter): the ready-made statistics start from here."""
    return rows.groupBy(
        F.col("l_suppkey").alias("channelId"),
        F.trunc(F.to_date("l_shipdate"), "MM").alias("month"), "l_partkey",
    )


def channel_chat_stats(spark, sf_dir) -> DataFrame:
    """Stand-in for the ready-made monthly chat statistics of a channel."""
    rows = table(spark, sf_dir, "lineitem")
    per_chatter = _channel_month_chatter(spark, sf_dir, rows).agg(
        F.count("*").alias("chats"),
        F.count_if(F.col("l_linestatus") == "F").alias("memberChats"),
        F.count_if(F.col("l_returnflag") == "A").alias("deletedChats"),
        F.max(F.col("l_returnflag") == "R").alias("banned"),
    )
    return per_chatter.groupBy("channelId", "month").agg(
        F.sum("chats").alias("chats"), F.sum("memberChats").alias("memberChats"),
        F.count("l_partkey").alias("uniqueChatters"),
        F.count_if(F.col("memberChats") > 0).alias("uniqueMembers"),
        F.count_if(F.col("banned")).alias("bannedChatters"),
        F.sum("deletedChats").alias("deletedChats"),
    ).withColumn("period", F.substring(F.col("month").cast("string"), 1, 7)).drop("month")


def channel_superchat_stats(spark, sf_dir) -> DataFrame:
    """Stand-in for the ready-made monthly super chat statistics of a channel."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    per_chatter = _channel_month_chatter(spark, sf_dir, rows).agg(
        F.count("*").alias("n"), F.sum(cents).alias("cents"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("letters"),
        F.max("l_linestatus").alias("status"), F.max("l_linenumber").alias("line"),
    )
    n = F.sum("n")
    return per_chatter.groupBy("channelId", "month").agg(
        n.alias("superChats"), F.count("l_partkey").alias("uniqueSuperChatters"),
        F.sum("cents").alias("totalSC"), F.floor(F.sum("cents") / n).alias("averageSC"),
        F.sum("letters").alias("totalMessageLength"),
        F.floor(F.sum("letters") / n).cast("string").alias("averageMessageLength"),
        F.max("status").alias("mostFrequentCurrency"),
        F.max("line").cast("string").alias("mostFrequentColor"),
    ).withColumn("period", F.substring(F.col("month").cast("string"), 1, 7)).drop("month")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages")


def labelled_documents(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def reviews(spark, sf_dir) -> DataFrame:
    """doc_id, polarity 1/2, title, text."""
    return labelled_documents(spark, sf_dir).select(
        "doc_id", (F.col("quality") + 1).alias("polarity"), F.col("source").alias("title"), "text"
    )


def flagged_messages(spark, sf_dir) -> DataFrame:
    """doc_id, body, label text naming the source: nonflagged or flagged."""
    source = F.when(F.col("toxic") == 0, "nonflagged").otherwise("flagged")
    return labelled_documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("body"), source.alias("label")
    )


def word_messages(spark, sf_dir) -> DataFrame:
    """Each white-space token of the labelled documents as one message, some with an emoji."""
    words = F.explode(F.split("text", r"\s+"))
    rows = labelled_documents(spark, sf_dir).select(words.alias("word"), F.col("toxic").alias("label"))
    mark = F.when(F.length("word") % 8 == 0, "\U0001F600 ").otherwise(" ")
    return rows.select(F.concat(F.lit(" "), "word", mark).alias("body"), "label")
