import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chatloom.operators import sketches, stats
from chatloom.sources import incremental

CHAT = "author long, channel long, ts timestamp, bodylength int"


def chats(spark, rows):
    return spark.createDataFrame([(a, c, dt.datetime.fromisoformat(t), n) for a, c, t, n in rows], CHAT)


@pytest.fixture
def months(spark, tmp_path):
    """A folder of monthly files and a way to write one, to refresh, and to read the table."""
    folder, table = tmp_path / "chats", str(tmp_path / "stats")
    schema = stats.author_stats(chats(spark, [])).schema

    class Months:
        built = []

        def write(self, name, rows):
            chats(spark, rows).coalesce(1).write.mode("overwrite").parquet(str(folder / name))

        def build(self, paths):
            self.built.append(paths)
            return stats.author_stats(spark.read.schema(CHAT).parquet(*paths))

        def refresh(self, **options):
            listed = incremental.source_files(spark, str(folder), "chats_", **options)
            return incremental.refresh(spark, listed, table, self.build)

        def rows(self):
            found = incremental.read_refreshed(spark, table, schema)
            return sorted((r["source_period"], r["author"], r["period"], r["chats"]) for r in found.collect())

        def files(self):
            return {f for d, _, names in os.walk(table) for f in names if f.endswith(".parquet")}

    out = Months()
    out.folder, out.table = folder, table
    return out


def test_only_changed_periods_are_built(months):
    months.write("chats_2021-01", [(1, 1, "2021-01-05", 3), (1, 2, "2021-01-06", 3), (2, 1, "2021-01-06", 3)])
    months.write("chats_2021-02", [(1, 1, "2021-02-05", 3)])
    months.write("chats_flagged_2021-02", [(9, 9, "2021-02-05", 3)])
    assert months.refresh(exclude=["flagged"]) == ["2021-01", "2021-02"]
    first, rows = months.files(), months.rows()
    assert rows == [("2021-01", 1, "2021-01", 2), ("2021-01", 2, "2021-01", 1), ("2021-02", 1, "2021-02", 1)]
    assert months.refresh(exclude=["flagged"]) == [] and months.files() == first
    months.write("chats_2021-03", [(3, 1, "2021-03-01", 1)])
    months.write("chats_2021-02", [(1, 1, "2021-02-05", 3), (1, 1, "2021-02-07", 3)])
    before = len(months.built)
    assert months.refresh(exclude=["flagged"]) == ["2021-02", "2021-03"] and len(months.built) == before + 2
    assert months.rows() == [*rows[:2], ("2021-02", 1, "2021-02", 2), ("2021-03", 3, "2021-03", 1)]
    assert {f for f in first if f in months.files()} and months.refresh(exclude=["flagged"]) == []


def test_a_second_file_and_files_that_go(spark, months):
    months.write("chats_2021-01", [(1, 1, "2021-01-05", 3)])
    months.write("chats_2021-02", [(1, 1, "2021-02-05", 3)])
    months.refresh()
    months.write("chats_2021-01_late", [(1, 1, "2021-01-07", 3)])
    assert months.refresh() == ["2021-01"] and months.rows()[0] == ("2021-01", 1, "2021-01", 2)
    for file in (months.folder / "chats_2021-02").iterdir():
        file.unlink()
    assert months.refresh() == ["2021-02"] and [r[0] for r in months.rows()] == ["2021-01"]
    months.write("chats_2021-01", [])
    months.write("chats_2021-01_late", [])
    assert months.refresh() == ["2021-01"] and months.rows() == []


def test_a_failed_build_is_repeated(months):
    months.write("chats_2021-01", [(1, 1, "2021-01-05", 3)])
    months.refresh()
    months.write("chats_2021-02", [(1, 1, "2021-02-05", 3)])
    build, months.build = months.build, lambda paths: 1 / 0
    with pytest.raises(ZeroDivisionError):
        months.refresh()
    months.build = build
    assert len(months.rows()) == 1 and months.refresh() == ["2021-02"] and len(months.rows()) == 2


def test_no_files_and_names_without_a_period(months):
    assert months.refresh() == [] and months.rows() == []
    months.write("chats_latest", [(1, 1, "2021-01-05", 3)])
    with pytest.raises(Exception, match="no period in the name"):
        months.refresh()


def test_sketches_merge_like_distinct_counts(spark):
    rows = [(a, c % (7 * a + 1), f"2021-{m:02d}-{1 + c % 27:02d}", c % 5) for a in (1, 2, 5) for m in range(1, 13) for c in range(120)]
    rows += [(9, None, "2021-05-01", None)]
    monthly = sketches.monthly_sketches(chats(spark, rows))
    found = sketches.merged_stats(monthly, F.substring("period", 1, 4), "year").collect()
    assert {(r["author"], r["year"], r["uniqueChatters"]) for r in found} == {(1, "2021", 8), (2, "2021", 15), (5, "2021", 36), (9, "2021", 0)}
    assert {r["author"]: (r["chats"], r["videoDays"], r["totalBodyLength"]) for r in found} == {
        1: (1440, 324, 2880), 2: (1440, 324, 2880), 5: (1440, 324, 2880), 9: (1, 1, None)}


def test_error_of_large_sketches_and_exact_small_ones(spark):
    sizes = [*range(1, sketches.EXACT + 1, 9), sketches.EXACT, 5_000, 40_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "author long").select(
        "author", F.explode(F.sequence(F.lit(1), "author")).alias("channel"))
    months = F.pmod(F.xxhash64("channel"), F.lit(12)) + 1
    chat = rows.select("author", "channel", F.make_timestamp(F.lit(2021), months, F.lit(3), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.lit(1).alias("bodylength"))
    chat = chat.unionByName(chat.withColumn("ts", F.lit(dt.datetime(2021, 6, 9))))
    found = sketches.merged_stats(sketches.monthly_sketches(chat), F.lit("all")).collect()
    for r in found:
        bound = 0 if r["author"] <= sketches.EXACT else sketches.RELATIVE_ERROR * r["author"]
        assert abs(r["uniqueChatters"] - r["author"]) <= bound, r


def test_monthly_sketches_are_shuffled_as_partial_aggregates(spark):
    plan = sketches.monthly_sketches(chats(spark, [(1, 1, "2021-01-05", 3)]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketchagg" in plan.lower().replace("_agg", "agg") or "partial_hll" in plan.lower()
