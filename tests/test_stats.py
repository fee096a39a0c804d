import datetime as dt

import pytest

from chatloom.operators import series, stats

CHAT = "author string, channel string, ts timestamp, bodylength int, member boolean"
SUPERCHAT = "author string, ts timestamp, significance double"


def at(month, day, hour=0):
    return dt.datetime(2021, month, day, hour)


@pytest.fixture(scope="module")
def chat(spark):
    return spark.createDataFrame([
        ("a", "x", at(1, 5), 10, True),
        ("a", "x", at(1, 5, 9), None, False),
        ("a", "y", at(1, 31), 5, None),
        ("a", None, at(1, 6), 1, False),
        ("a", "z", at(2, 1), 7, True),
        ("b", "x", at(1, 1), 2_000_000_000, False),
        ("b", "x", at(1, 1), 2_000_000_000, None),
        ("c", "x", None, 3, True),
    ], CHAT)


@pytest.fixture(scope="module")
def superchat(spark):
    return spark.createDataFrame([
        ("a", at(1, 7), 1.0), ("a", at(1, 8), 4.0), ("a", at(3, 1), 2.0), ("d", at(1, 1), 5.0),
    ], SUPERCHAT)


def by_key(df):
    return {(r["author"], r["period"]): r for r in df.collect()}


def test_author_stats(chat):
    got = by_key(stats.author_stats(chat))
    assert set(got) == {("a", "2021-01"), ("a", "2021-02"), ("b", "2021-01"), ("c", None)}
    january = got["a", "2021-01"]
    assert january["chats"] == 4 and january["videoDays"] == 3
    assert january["uniqueChatters"] == 2 and january["totalBodyLength"] == 16
    assert got["b", "2021-01"]["totalBodyLength"] == 4_000_000_000
    assert got["b", "2021-01"]["videoDays"] == 1
    assert got["c", None]["chats"] == 0 and got["c", None]["videoDays"] == 0


def test_author_stats_counts_bodies(chat):
    assert by_key(stats.author_stats(chat, "bodylength"))["a", "2021-01"]["chats"] == 3


def test_author_stats_of_nothing(chat):
    assert stats.author_stats(chat.limit(0)).count() == 0


def test_superchat_stats(superchat):
    got = by_key(stats.superchat_stats(superchat))
    assert got["a", "2021-01"]["superchats"] == 2
    assert got["a", "2021-01"]["avgSignificance"] == 2.5


def test_combined_stats_needs_the_same_month(chat, superchat):
    inner = by_key(stats.combined_stats(chat, superchat))
    assert set(inner) == {("a", "2021-01")}
    right = by_key(stats.combined_stats(chat, superchat, "right"))
    assert set(right) == {("a", "2021-01"), ("a", "2021-03"), ("d", "2021-01")}
    assert right["d", "2021-01"]["chats"] is None and right["d", "2021-01"]["superchats"] == 1
    joined = stats.join_stats(stats.author_stats(chat), stats.superchat_stats(superchat))
    assert by_key(joined) == inner


def test_member_stats(chat):
    got = by_key(stats.member_stats(chat))
    assert got["a", "2021-01"]["uniqueMembers"] == 1
    assert got["b", "2021-01"]["uniqueMembers"] is None
    filled = by_key(stats.member_stats(chat, fill=True))
    assert filled["b", "2021-01"]["uniqueMembers"] == 0


def test_member_chat_without_channel_counts_zero(spark):
    chat = spark.createDataFrame([("a", None, at(1, 1), 1, True)], CHAT)
    assert stats.member_stats(chat).first()["uniqueMembers"] == 0


def test_stats_do_not_depend_on_partitions(chat, rows_under):
    for build in (lambda: stats.author_stats(chat), lambda: stats.member_stats(chat)):
        assert rows_under(build, 1) == rows_under(build, 50)


def test_log_targets(spark):
    df = spark.createDataFrame([(0,), (1,), (100,), (-3,), (None,)], "superchats int")
    rows = {r["superchats"]: r for r in stats.log_targets(df).collect()}
    assert rows[0]["log10_superchats"] is None and rows[-3]["log2_superchats"] is None
    assert rows[1]["log10_superchats"] == 0 and rows[100]["log10_superchats"] == 2
    assert rows[None]["log2_superchats"] is None


def test_with_mean(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r["mean"] for r in stats.with_mean(df, "x", df.where("x > 1")).collect()] == [3.0, 3.0]


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame([
        ("c1", "名", "Name", "Org", 10, 2, "http://photo"), ("c2", "b", "b", None, None, 0, ""),
    ], "channelId string, name string, englishName string, affiliation string, "
       "subscriptionCount long, videoCount long, photo string")


def test_channel_stats(spark, channels):
    monthly = spark.createDataFrame([("c1", "2021-01", 3), ("c9", "2021-01", 1)],
                                    "channelId string, period string, chats long")
    joined = stats.channel_stats(channels, monthly)
    assert joined.columns.count("channelId") == 1 and "photo" not in joined.columns
    assert [r["chats"] for r in joined.collect()] == [3]


def test_series_stay_aligned(spark, channels):
    columns = "channelId string, period string, " + ", ".join(
        f"{m} long" for m in series.CHAT_MEASURES
    )
    monthly = spark.createDataFrame([
        ("c1", "2021-03", 3, 1, 2, None, 0, 0),
        ("c1", "2021-01", 1, None, 1, 1, 0, 0),
        ("c1", "2021-02", None, 2, 1, 1, 0, 5),
    ], columns)
    row = series.chat_series(channels, monthly).first()
    assert row["period"] == ["2021-01", "2021-02", "2021-03"]
    assert row["chats"] == [1, None, 3]
    assert row["memberChats"] == [None, 2, 1]
    assert row["deletedChats"] == [0, 5, 0]
    assert row["name"] == "名" and row["subscriptionCount"] == 10


def test_a_month_given_twice_keeps_both_entries(spark, channels):
    columns = "channelId string, period string, " + ", ".join(
        f"{m} long" for m in series.CHAT_MEASURES
    )
    months = [("c1", "2021-03", 3, 1, 2, None, 0, 0), ("c1", "2021-02", 9, 1, 1, 1, 1, 1), ("c1", "2021-03", 1, 1, 2, None, 0, 0)]
    row = series.chat_series(channels, spark.createDataFrame(months, columns)).first()
    assert row["period"] == ["2021-02", "2021-03", "2021-03"] and row["chats"] == [9, 1, 3]
