import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.sources import incremental, inspection


def test_narrowest_types(spark, tmp_path):
    lines = [
        "whole,real,day,time,code,text,mixed,none,big,quoted name",
        "1,1,2021-01-05,2021-01-05 10:00:00,007,a,1,,9223372036854775807,1",
        "-20,2.5,2021-02-28,2021-01-05,012,b,x,,1,",
        "0,1e3,,2021-01-05T10:00:00.5Z,100,,2021-01-05,,2,3",
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    types = inspection.infer_header_csv(spark, str(tmp_path / "a.csv"))
    found = {r["column"]: (r["type"], r["present"]) for r in types.collect()}
    assert found == {
        "whole": ("bigint", 3), "real": ("double", 3), "day": ("date", 2), "time": ("timestamp", 3), "code": ("string", 3),
        "text": ("string", 2), "mixed": ("string", 3), "none": ("string", 0), "big": ("bigint", 3), "quoted name": ("bigint", 2),
    }
    schema = inspection.declared(types)
    rows = spark.read.schema(schema).option("header", True).csv(str(tmp_path / "a.csv"))
    assert rows.where("whole = -20 AND real = 2.5 AND day = DATE '2021-02-28'").count() == 1


@pytest.mark.parametrize(("value", "type_"), [
    ("9223372036854775808", "double"), ("2021-02-30", "string"), ("nan", "string"), ("1.", "double"), ("0.5", "double"),
    ("00.5", "string"), ("+3", "bigint"), ("2021-01-05 25:00", "string"), ("1,5", "string"), (" 1", "string"), ("1d", "string"),
])
def test_types_of_single_values(spark, value, type_):
    assert inspection.inferred_types(spark.createDataFrame([(value,), (None,)], "`a.b` string")).first()["type"] == type_


def test_no_rows_are_text(spark):
    assert [tuple(r) for r in inspection.inferred_types(spark.createDataFrame([], "a string")).collect()] == [(0, "a", "string", 0)]


def test_bad_lines_come_back_by_file(spark, tmp_path):
    schema = StructType.fromDDL("name string, n bigint, x double")
    (tmp_path / "a.csv").write_text('name,n,x\nfine,1,2.5\nshort,1\nlong,1,2,3\nword,many,1\n"quoted, ""text""",2,\n\n')
    (tmp_path / "b.csv").write_text("name,n,x\nalso fine,3,1\n,,\nbad,1,x\n")
    good, bad = inspection.read_checked_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schema, header=True)
    assert sorted(map(str, map(tuple, good.collect()))) == sorted(map(str, [
        ("fine", 1, 2.5), ('quoted, "text"', 2, None), ("also fine", 3, 1.0), (None, None, None)]))
    rows = sorted((r["file"].rsplit("/", 1)[1], r["block"], r["record"]) for r in bad.collect())
    assert rows == [("a.csv", 0, "long,1,2,3"), ("a.csv", 0, "short,1"), ("a.csv", 0, "word,many,1"), ("b.csv", 0, "bad,1,x")]
    assert good.columns == schema.names and good.agg(F.sum("n")).first()[0] == 6


def test_unreadable_and_empty_files_are_listed(spark, tmp_path):
    folder = tmp_path / "some + files"
    for name, n in (("chats_2021-01", 5), ("chats_2021-02", 5), ("chats_2021-03", 0)):
        spark.range(n).selectExpr("id", "cast(id AS string) AS text").coalesce(1).write.parquet(str(folder / name))
    torn = next((folder / "chats_2021-02").glob("*.parquet"))
    torn.write_bytes(torn.read_bytes()[:-9])
    for crc in (folder / "chats_2021-02").glob(".*.crc"):
        crc.unlink()
    listed = incremental.source_files(spark, str(folder), "chats_")
    silent = {r["path"].rsplit("/", 2)[1] for r in inspection.silent_files(spark, listed).collect()}
    assert silent == {"chats_2021-02", "chats_2021-03"}
    assert inspection.silent_files(spark, listed.limit(0)).count() == 0
