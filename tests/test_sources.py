"""Reading and writing files, and streams against batch."""

import datetime as dt
import json

from pyspark.sql import functions as F

from isotherm.operators.cleaning import clean_panel
from isotherm.schemas import RAW_PANEL
from isotherm.session import new_work_path
from isotherm.sources import bundle, delimited, sinks, uploads
from isotherm.streaming.ingest import ingest_uploads
from isotherm.streaming.rollup import daily_summaries
from isotherm.streaming.run import run_available

from tests.test_golden import panel_rows


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_PANEL)


def test_read_table(spark):
    path = new_work_path(spark, "csv")
    rows = [("  Iran ", "Asia", "2001", "12.5 C"), ("Narnia", "x  y", "2002", ""), ("Oman", None, "2003", "1,2")]
    spark.createDataFrame(rows, "`Country ` string, Region string, Year string, `Avg  Temperature` string").write.option("header", True).csv(path)
    got = delimited.read_table(spark, path, RAW_PANEL)
    assert got.columns == ["Country", "Region", "Year", "Avg Temperature"]
    assert {tuple(r) for r in got.collect()} == {
        ("Iran", "Middle East", "2001", 12.5), ("Narnia", "x y", "2002", None), ("Oman", "Middle East", "2003", 12.0)
    }
    empty = delimited.read_table(spark, path + "-absent", RAW_PANEL)
    assert empty.columns == RAW_PANEL.names and empty.count() == 0


def test_datasets(spark):
    root = new_work_path(spark, "root")
    one = spark.createDataFrame([("R", 1)], "Region string, FirstYear int")
    sinks.write_table(one, f"{root}/regional_trends", "default")
    sinks.write_table(one.withColumn("Region", F.lit("S")), f"{root}/regional_trends", "upload")
    sinks.write_table(one.withColumn("Region", F.lit("T")), f"{root}/regional_trends", "upload")
    tables = bundle.load_dataset(spark, root, "upload")
    assert [r["Region"] for r in tables["regional_trends"].collect()] == ["T"]
    assert [r["Region"] for r in bundle.load_table(spark, root, "regional_trends", "default").collect()] == ["R"]
    assert tables["main"].count() == 0 and "AvgTemperature" in tables["main"].columns
    plan = tables["regional_trends"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset_id" in plan


def test_records(spark):
    rows = [("a", float("nan"), None), (None, float("inf"), 3), ('x":null,', 1.5, 4)]
    df = spark.createDataFrame(rows, "s string, d double, n int")
    got = [json.loads(r[0]) for r in sinks.records(df).collect()]
    assert got == [{"s": "a", "d": 0, "n": 0}, {"s": 0, "d": 0, "n": 3}, {"s": 'x":null,', "d": 1.5, "n": 4}]


def test_export(spark):
    path = new_work_path(spark, "export")
    df = spark.createDataFrame([('say "Ring"', 1234, 2.5), ("b", 2, 1.0)], "name string, n int, v double")
    sinks.export_search(df, "RING", path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).collect()
    assert [tuple(r) for r in back] == [('say "Ring"', "1,234", "2.500")]


def test_stream_ingest_picks_up_new_files(spark):
    folder, out, log = (new_work_path(spark, n) for n in ("in", "out", "log"))
    first = raw(spark, [("Iran", "x", "2001", "1.5"), ("Iran", "x", "20x1", "1.5"), (None, None, None, None)])
    second = raw(spark, [("Narnia", "West", "2002.0", "3 °C")])
    first.coalesce(1).write.mode("append").option("header", True).csv(folder)
    ingest_uploads(spark, folder, out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    second.coalesce(1).write.mode("append").option("header", True).csv(folder)
    ingest_uploads(spark, folder, out, log).awaitTermination()
    got = spark.read.parquet(out)
    want = clean_panel(first.unionByName(second))
    assert sorted(map(tuple, got.drop("dataset_id", "batch").collect())) == sorted(map(tuple, want.collect()))
    assert got.select("dataset_id").distinct().count() == got.select("batch").distinct().count() == 2


def test_uploads_by_their_own_headers(spark):
    """Two uploads of the golden panel, one with its columns in another order under other names, batch and stream."""
    folder = new_work_path(spark, "golden")
    first = raw(spark, list(panel_rows()))
    second = first.withColumn("Year", (F.col("Year") + 20).cast("int").cast("string"))
    write = lambda df: df.coalesce(1).write.mode("append").option("header", True).csv(folder)
    write(first)
    write(second.select(F.col("AvgTemperature").alias(" temperature"), F.lit("a, b").alias("note"), F.col("Year").alias("YEAR"), "Region", "Country"))
    write(second.select("Country", "Year", "AvgTemperature"))
    want = sorted(map(tuple, clean_panel(first.unionByName(second)).collect()))
    assert len(want) == 1400
    batch = clean_panel(uploads.read_uploads(spark, folder))
    assert sorted(map(tuple, batch.drop("dataset_id").collect())) == want
    out = new_work_path(spark, "golden-out")
    ingest_uploads(spark, folder, out, new_work_path(spark, "golden-log"), files_per_batch=1).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).drop("dataset_id", "batch").collect())) == want
    report = uploads.upload_report(spark, folder).collect()
    assert sorted((r["missing"], r["n_rows"]) for r in report) == [("", 700), ("", 700), ("Region", 0)]
    assert spark.read.parquet(f"{out}-headers").where("missing = 'Region'").count() == 1


def test_stream_rollup_matches_batch(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(at(1, 3), "a", 1.0), (at(1, 9), "a", 2.0), (at(1, 9), "b", 5.0), (at(2, 1), "a", 7.0), (at(9, 0), "z", 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, location string, value double")
    folder = new_work_path(spark, "readings")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = run_available(daily_summaries(stream), "days").collect()
    want = daily_summaries(df).where("location <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_uploads_of_one_name(spark, tmp_path):
    """Two files of one name in two folders: the refused one has no rows."""
    for folder, text in (("a", "Country,Region,Year,AvgTemperature\nPeru,South America,2001,20.5\n"), ("b", "Country,Year,AvgTemperature\nPeru,2001,20.5\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(text)
    rows = uploads.upload_report(spark, f"{tmp_path}/*/*.csv").collect()
    found = {r["file"].split("/")[-2]: (r["dataset_id"], r["missing"], r["n_rows"]) for r in rows}
    assert found == {"a": ("x.csv", "", 1), "b": ("x.csv", "Region", 0)}


def test_lines_of_a_file_are_not_brought_together(spark, tmp_path):
    """The headers are a small written table, so a large file's lines stay in the tasks that read them."""
    (tmp_path / "a.csv").write_text("Country,Region,Year,AvgTemperature\nPeru,South America,1999,20.5\n")
    (tmp_path / "b.csv").write_text("Year,Country,AvgTemp,Region\n2000,Chad,30.5,Africa\n")
    lines = uploads.upload_lines(spark.read.text(str(tmp_path)))
    rows = uploads.panel_rows(lines, uploads.upload_headers(lines))
    assert sorted(tuple(r) for r in rows.collect()) == [("Chad", "Africa", "2000", "30.5", "b.csv"), ("Peru", "South America", "1999", "20.5", "a.csv")]
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
