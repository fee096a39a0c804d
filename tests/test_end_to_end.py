"""Raw chat files to statistics, documents and published scores."""

from pyspark.sql import functions as F

from chatloom import schemas
from chatloom.operators import models, series, stats
from chatloom.plans import bindings, jobs
from chatloom.sources import readers, writers

SF_DIR = "/root/testdata/sf0.001"


def write_raw_files(spark, folder):
    """Monthly files of raw chats and super chats, as downloaded."""
    year = F.date_format("ts", "yyyy")
    chat = bindings.chat(spark, SF_DIR).select(
        F.col("author").cast("string").alias("authorChannelId"),
        F.col("channel").cast("string").alias("channelId"), F.col("ts").alias("timestamp"),
        "bodylength", F.col("member").cast("string").alias("isMember"), year.alias("year"),
    )
    superchat = bindings.superchat(spark, SF_DIR).select(
        F.col("author").cast("string").alias("authorChannelId"), F.col("ts").alias("timestamp"),
        "significance", year.alias("year"),
    )
    for name in ("1995", "1996", "1997"):
        for prefix, df in (("chats_", chat), ("superchats_", superchat)):
            part = df.where(F.col("year") == name).drop("year").coalesce(1)
            part.write.parquet(f"{folder}/{prefix}{name}.parquet")
    chat.drop("year").limit(5).write.parquet(f"{folder}/chats_flagged_1995.parquet")


def test_raw_files_to_scores(spark, tmp_path):
    folder = str(tmp_path)
    write_raw_files(spark, folder)
    chat = readers.read_chats(spark, folder, corrupt=["1997"])
    superchat = readers.read_superchats(spark, folder, corrupt=["1997"])

    combined = writers.materialize(
        spark, f"{folder}/combined", lambda: stats.combined_stats(chat, superchat), ["period"]
    )
    wanted = stats.combined_stats(
        bindings.chat(spark, SF_DIR).withColumn("author", F.col("author").cast("string")),
        bindings.superchat(spark, SF_DIR).withColumn("author", F.col("author").cast("string")),
    ).where("period < '1997'")
    assert combined.count() == wanted.count() > 0
    assert combined.select(*wanted.columns).exceptAll(wanted).isEmpty()

    stored = jobs.regression_table(combined)
    assert stored.count() == combined.count()
    data = jobs.regression_data(chat, superchat)
    assert {r["split"] for r in data.select("split").distinct().collect()} == {"train", "test"}
    held = data.select("period", "split").distinct()
    assert held.count() == held.select("period").distinct().count()
    board = models.leaderboard(data, ["superchats", jobs.LABEL])
    assert writers.write_once(board, f"{folder}/scores")
    assert not writers.write_once(board, f"{folder}/scores")
    published = spark.read.json(f"{folder}/scores")
    assert published.count() == 15 and set(published.columns) == set(board.columns)


def test_csv_statistics_to_documents(spark, tmp_path):
    (tmp_path / "channels.csv").write_text(
        "photo,channelId,name,englishName,affiliation,subscriptionCount,videoCount\n"
        "p,c1,n,e,o,12.5,many\n"
    )
    (tmp_path / "chat.csv").write_text(
        "channelId,period,chats,memberChats,uniqueChatters,uniqueMembers,bannedChatters,deletedChats\n"
        "c1,2021-02,5,,3,1,0,0\nc1,2021-01,4,2,2,1,0,x\n"
    )
    (tmp_path / "superchat.csv").write_text(
        "channelId,period,superChats,uniqueSuperChatters,totalSC,averageSC,totalMessageLength,"
        "averageMessageLength,mostFrequentCurrency,mostFrequentColor\n"
        "c1,2021-01,1,1,500,500,7,7.5,JPY,blue\nc2,2021-01,1,1,500,500,7,7.5,JPY,blue\n"
    )
    chat, superchat = jobs.channel_documents(
        spark, *(str(tmp_path / f"{n}.csv") for n in ("channels", "chat", "superchat"))
    )
    row = chat.first()
    assert row["subscriptionCount"] == 12 and row["videoCount"] is None
    assert row["period"] == ["2021-01", "2021-02"] and row["chats"] == [4, 5]
    assert row["memberChats"] == [2, None] and row["deletedChats"] == [None, 0]
    assert [r["mostFrequentColor"] for r in superchat.collect()] == [["blue"]]
    assert superchat.first()["averageMessageLength"] == ["7.5"]


def test_message_samples(spark, tmp_path):
    rows = [(f"word\U0001F600" if i % 3 else "two words", str(i % 2)) for i in range(300)]
    messages = spark.createDataFrame(rows, schemas.MESSAGES)
    paths = jobs.write_samples(messages, str(tmp_path), sizes=(20, 150))
    read = [readers.read_csv(spark, p, schemas.MESSAGES, header=True) for p in paths]
    assert [df.count() for df in read] == [20, 150]
    assert {r["body"] for r in read[1].collect()} == {"word"}


def test_channel_documents_are_written_once(spark, tmp_path):
    channels = bindings.channels(spark, SF_DIR)
    documents = series.chat_series(channels, bindings.channel_chat_stats(spark, SF_DIR))
    path = str(tmp_path / "chat")
    assert writers.write_once(documents, path) and not writers.write_once(documents, path)
    row = spark.read.json(path).first()
    assert len(row["period"]) == len(row["chats"]) == len(row["deletedChats"]) > 1
    assert row["period"] == sorted(row["period"])
