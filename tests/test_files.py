import os

import pytest
from pyspark.sql import functions as F

from chatloom import schemas
from chatloom.session import pinned, scratch_path, shared_folder, shuffle_settings, unpin
from chatloom.sources import readers, writers


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, ids):
        spark.createDataFrame(
            [(f"a{i}", "c", "2021-03-01 10:00:00", i, "true" if i % 2 else "false") for i in ids],
            "authorChannelId string, channelId string, timestamp string, bodylength int, isMember string",
        ).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    write("chats_2021-03.parquet", [1, 2])
    write("chats_2021-04.parquet", [3])
    write("chats_flagged_2021-03.parquet", [4])
    write("superchats_2021-03.parquet", [5])
    (tmp_path / "chats_2021-05.parquet").write_bytes(b"not parquet")
    return str(tmp_path)


def test_read_chats_by_name(spark, folder):
    chats = readers.read_chats(spark, folder, corrupt=["2021-05"])
    assert chats.columns == ["author", "channel", "ts", "bodylength", "member"]
    assert {(r["author"], r["member"]) for r in chats.collect()} == {
        ("a1", True), ("a2", False), ("a3", True)
    }
    named = readers.read_named(spark, folder, "superchats_")
    assert [r["authorChannelId"] for r in named.collect()] == ["a5"]
    with pytest.raises(FileNotFoundError):
        readers.read_named(spark, folder, "bans_")
    with pytest.raises(FileNotFoundError):
        readers.read_named(spark, f"{folder}/nowhere", "chats_")


def test_raw_text_columns_that_cannot_be_read_become_null(spark):
    raw = spark.createDataFrame(
        [("a", "c", "2021-03-01 10:00:00", "5", "true"), ("a", "c", "soon", "long", None)],
        "authorChannelId string, channelId string, timestamp string, bodylength string, isMember string",
    )
    rows = readers.chat_columns(raw).collect()
    assert rows[0]["ts"].month == 3 and rows[0]["bodylength"] == 5 and rows[0]["member"]
    assert rows[1]["ts"] is None and rows[1]["bodylength"] is None and rows[1]["member"] is None
    superchat = raw.withColumn("significance", F.lit("x"))
    assert readers.superchat_columns(superchat).first()["significance"] is None


def test_read_labelled(spark, folder):
    stacked = readers.read_labelled(spark, f"{folder}/chats_2021-0[34]*", f"{folder}/chats_flagged_*")
    assert {(r["authorChannelId"], r["label"]) for r in stacked.collect()} == {
        ("a1", 0), ("a2", 0), ("a3", 0), ("a4", 1)
    }


def test_csv_keeps_quotes_commas_and_breaks(spark, tmp_path):
    texts = ['he said "hi, you"', "two\nlines", " padded ", "", None, "a\\b"]
    df = spark.createDataFrame([(i, "t", x) for i, x in enumerate(texts)], schemas.REVIEWS)
    path = str(tmp_path / "reviews")
    writers.replace_csv(df, path)
    got = {r["polarity"]: r["text"] for r in readers.read_csv(spark, path, schemas.REVIEWS, multiline=True).collect()}
    assert got[0] == texts[0] and got[1] == texts[1] and got[2] == texts[2] and got[5] == texts[5]
    plain = tmp_path / "plain.csv"
    plain.write_text('1,t,"he said ""hi, you"""\nx,t,b\n')
    rows = readers.read_csv(spark, str(plain), schemas.REVIEWS).collect()
    assert rows[0]["text"] == 'he said "hi, you"' and rows[1]["polarity"] is None


def test_header_csv_with_casts(spark, tmp_path):
    path = tmp_path / "stats.csv"
    path.write_text("channelId,period,chats\nc1,2021-01,12\nc2,2021-01,many\n")
    got = readers.read_text_columns(spark, str(path), {"chats": "bigint"})
    assert [(r["channelId"], r["chats"]) for r in got.collect()] == [("c1", 12), ("c2", None)]
    channels = tmp_path / "channels.csv"
    channels.write_text("channelId,name,englishName,affiliation,subscriptionCount,videoCount,photo\n"
                        "c1,n,e,o,3000000000,2,p\n")
    row = readers.read_csv(spark, str(channels), schemas.CHANNELS, header=True).first()
    assert row["subscriptionCount"] == 3_000_000_000 and row["name"] == "n"


def test_numbered_files_join_with_their_shift(spark, tmp_path):
    from chatloom.plans.jobs import combine_numbered

    (tmp_path / "chat_v2_2.csv").write_text("a,2021-03,5,2,1,50\nb,2021-03,1,1,1,5\n")
    (tmp_path / "chat_v2_12.csv").write_text("a,2022-01,7,3,1,70\n")
    (tmp_path / "superchat_0.csv").write_text("a,3,1.5\n")
    (tmp_path / "superchat_10.csv").mkdir()
    (tmp_path / "superchat_10.csv" / "part-00000-c000.csv").write_text("a,4,2.5\nb,9,1.0\n")
    got = combine_numbered(spark, f"{tmp_path}/chat_v2_", f"{tmp_path}/superchat_", [2, 12]).collect()
    assert {(r["author"], r["period"], r["chats"], r["superchats"], r["avgSignificance"]) for r in got} == {
        ("a", "2021-03", 5, 3, 1.5), ("a", "2022-01", 7, 4, 2.5)
    }


def test_replace_overwrites_and_can_write_one_file(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.replace(spark.range(10), path)
    writers.replace(spark.range(4).repartition(3), path, single_file=True)
    assert spark.read.parquet(path).count() == 4
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 1


def test_partitioned_writes_make_few_files(spark, tmp_path):
    path = str(tmp_path / "by-period")
    rows = spark.range(4000).repartition(16).select("id", F.concat(F.lit("2021-0"), F.col("id") % 4 + 1).alias("period"))
    writers.replace(rows, path, partition_by=["period"])
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert spark.read.parquet(path).count() == 4000 and len(files) <= 8


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "documents")
    assert writers.write_once(spark.range(3), path)
    assert not writers.write_once(spark.range(9), path)
    assert spark.read.json(path).count() == 3


def test_materialize_builds_once_and_never_overwrites(spark, tmp_path):
    path, built = str(tmp_path / "stats"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("2021-01", 1), ("2021-02", 2)], "period string, n int")

    for _ in range(2):
        table = writers.materialize(spark, path, build, ["period"])
        assert sorted((r["period"], r["n"]) for r in table.collect()) == [("2021-01", 1), ("2021-02", 2)]
    assert len(built) == 1
    typed = writers.materialize(spark, path, build, ["period"], "n int, period string")
    assert dict(typed.dtypes) == {"n": "int", "period": "string"}
    os.remove(f"{path}/_SUCCESS")
    with pytest.raises(FileExistsError):
        writers.materialize(spark, path, build, ["period"])
    assert len(built) == 1 and spark.read.parquet(path).count() == 2


def test_foreign_folders_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "foreign")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(path)
    with pytest.raises(FileExistsError):
        writers.write_once(spark.range(1), path)
    assert spark.read.json(path).count() == 3
    (tmp_path / "empty").mkdir()
    assert writers.write_once(spark.range(2), str(tmp_path / "empty"))
    assert spark.read.json(str(tmp_path / "empty")).count() == 2


def test_split_and_predictions_are_written(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") < 3, "test").otherwise("train").alias("split"))
    paths = writers.write_split(rows, str(tmp_path))
    assert [spark.read.csv(p, header=True).count() for p in paths] == [7, 3]
    vectors = rows.withColumn("prediction", F.lit(1.0)).withColumn("rawPrediction", F.array(F.lit(1.0)))
    writers.write_predictions(vectors, f"{tmp_path}/predictions", ["id", "prediction"])
    assert spark.read.json(f"{tmp_path}/predictions").columns == ["id", "prediction"]


def test_pinned_tables_live_in_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder
    assert scratch_path(spark, "x").startswith(folder)
    table = pinned(spark.range(5).withColumn("r", F.rand()))
    assert table.collect() == table.collect()
    assert all(folder in path for path in table.inputFiles())
    place = table.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert os.path.exists(place)
    unpin(table)
    assert not os.path.exists(place)


def test_score_records(spark):
    from chatloom.operators.models import score_records

    record = {name: 1.0 for name in schemas.SCORES.names} | {"model": "m", "label_col": "superchats"}
    assert score_records(spark, [record]).first()["Test MAE"] == 1.0


def test_shuffle_width_follows_the_bytes():
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert shuffle_settings(10)[name] == "200"
    assert shuffle_settings(20 * 2 ** 40)[name] == "163840"
