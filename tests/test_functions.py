"""Single functions on tiny tables."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from isotherm.functions import numbers, questions, text
from isotherm.functions.lookups import REGION_OF_COUNTRY, WEATHER_CODES
from isotherm.functions.markup import blocks, label_values, typed_lines, weather_fields
from isotherm.operators import cleaning, linking, panel, profile, ranking, rollup, selection, trends


def column(spark, values, build, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]


def test_measures(spark):
    texts = ["12.5 °C", "1,234.5", "12 degree", " ", "nan", "inf", "8.8e-16", "abc", "12d", "7Â°C", None, "1e999", "-3"]
    want = [12.5, 1234.5, 12.0, None, None, None, 8.8e-16, None, None, 7.0, None, None, -3.0]
    assert column(spark, texts, numbers.parse_measure) == want


def test_loose_numbers(spark):
    assert column(spark, ["t 12.5 C!", "8.8e-16", "-4 deg", "x"], numbers.parse_loose_number) == [12.5, 8.8e-16, -4.0, None]


def test_years(spark):
    assert column(spark, ["2001", "2001.9", "20x1", None, "99999999999"], numbers.parse_year) == [2001, 2001, None, None, None]


def test_rounding_is_exact(spark):
    random.seed(3)
    values = [16.2375, 2.675, -0.0005, 0.5, 1.0005, 1e9 + 0.0005] + [random.randint(0, 10**7) / 2000 for _ in range(500)]
    assert column(spark, values, lambda x: numbers.round_to(x, 3), "double") == [round(v, 3) for v in values]


def test_slope_is_exact(spark):
    rows = [("a", 2000 + i, v) for i, v in enumerate([1.5, 1.25, 4.125, 2.0])] + [("b", 2000, 3.0), ("c", 2000, 1.0), ("c", 2000, 5.0)]
    df = spark.createDataFrame(rows, "k string, x int, y double")
    got = dict(df.groupBy("k").agg(numbers.slope(F.col("y"), F.col("x"), 3)).collect())
    assert got == {"a": 0.4375, "b": 0.0, "c": 0.0}


def test_value_class_and_units(spark):
    texts = ["+1.2 C change", "-0.1 warming", "30 C", "3 C", "20", "n/a", ""]
    assert column(spark, texts, numbers.value_class) == ["up", "down", "hot", "cold", "neu", "neu", "neu"]
    assert column(spark, ["5 km/h", "5", "-", None], lambda c: numbers.append_unit(c, " km/h")) == ["5 km/h", "5 km/h", "-", "-"]


def test_top_n(spark):
    asked = ["top-10 hottest", "show me 5", "12 regions please", "Top 999", "the 7 best rows", "none", "top 99999999999999999999"]
    assert column(spark, asked, questions.top_n) == [10, 5, 12, 200, 7, 10, 200]


def test_intents_and_types(spark):
    asked = ["compare weather and climate", "rain in 1999", "is it windy", "warming trends", "hello", ""]
    assert column(spark, asked, questions.intent) == ["comparison", "climate", "weather", "climate", "unsupported", "unsupported"]
    asked = ["how many countries", "explain", "median", "hottest", "a vs b", "since when", "in europe", "xyz"]
    assert column(spark, asked, questions.question_type) == ["meta", "summary", "stat", "rank", "compare", "trend", "filter", "general"]
    assert column(spark, ["customers"], lambda c: questions.question_type(c, whole_words=True)) == ["general"]


@pytest.mark.parametrize("words", list(questions.TYPE_WORDS.values()) + [questions.ROUTE_TABLE, questions.FOLLOWUP_FRESH])
def test_keyword_pattern_finds_the_same(words):
    import re

    random.seed(1)
    plain, quick = re.compile("|".join(words)), re.compile(text.any_of(words))
    for _ in range(300):
        parts = [random.choice(words) for _ in range(2)]
        sample = parts[0][: random.randint(0, 9)] + random.choice(["", " ", "x"]) + parts[1][random.randint(0, 3):]
        assert bool(plain.search(sample)) == bool(quick.search(sample)), sample


DATES = {
    "on december 20, 1995?": "1995-12-20", "20th december 1995": "1995-12-20", "2003-12-20": "2003-12-20",
    "20/12/2003": "2003-12-20", "march 2023": "2023-03", "2023 march": "2023-03", "in 1995": "1995", "1995-13-40": "1995",
    "feb 30 2001": "2001", "2003-02-30 or 2001": "2003", "in 2050": None, "31/01/2050": None, "": None, "december 2024": "2024",
}


def test_dates(spark):
    rows = spark.createDataFrame(list(enumerate(DATES)), "i int, x string")
    got = text.with_date(rows, "x", F.lit(dt.date(2024, 6, 30))).orderBy("i").collect()
    assert [r["date"] for r in got] == list(DATES.values())


PLACES = {
    "weather in New York today": "New York", "Rain at Paris?": "Paris", "forecast for Rome from Monday": "Rome",
    "temperature Oslo": "Oslo", "temperature in Chennai on 20th December 1995": "Chennai", "weather now": None,
    "what is in the 1999 table": "the table", "für ein Haus": None, "": None,
}


def test_places(spark):
    rows = spark.createDataFrame(list(enumerate(PLACES)), "i int, x string")
    got = text.with_place(rows, "x").orderBy("i").collect()
    assert [r["place"] for r in got] == list(PLACES.values())
    assert column(spark, [" nyc", "UK", "são paulo", None], text.place_name) == ["New York", "United Kingdom", "São Paulo", ""]


def test_periods(spark):
    got = column(spark, ["2024-06-15", "2024-06", "2024-02", "2024", "2023", "June"], lambda c: text.period_bounds(c, F.lit(dt.date(2024, 6, 20))))
    assert [tuple(g) for g in got] == [
        ("day", "2024-06-15", "2024-06-15", "2024-06-15"), ("month", "2024-06-01", "2024-06-20", "June 2024"),
        ("month", "2024-02-01", "2024-02-29", "February 2024"), ("year", "2024-01-01", "2024-06-20", "2024"),
        ("year", "2023-01-01", "2023-12-31", "2023"), (None, None, None, None),
    ]


def test_followups(spark):
    asked = ["why is that?", "last 5 years", "what about Peru in summer", "tell me more about the top 5", "latest year details", "hello"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, x string")
    parsed = text.parse_texts(rows, "x", F.lit(dt.date(2024, 6, 30))).orderBy("i")
    got = [r[0] for r in parsed.select(questions.is_followup(F.col("q"), F.col("place"))).collect()]
    assert got == [True, True, False, False, False, False]


def test_headers_and_mapping(spark):
    df = spark.createDataFrame([("a", "b", "2001", "1")], ["  COUNTRY ", "region", "Year", "avg_temp  "])
    clean = cleaning.clean_headers(df)
    assert clean.columns == ["COUNTRY", "region", "Year", "avg_temp"]
    assert cleaning.canonical_columns(clean).columns == ["Country", "Region", "Year", "AvgTemperature"]
    with pytest.raises(ValueError, match="AvgTemperature"):
        cleaning.panel_mapping(clean.drop("avg_temp"))


def test_region_corrections(spark):
    df = spark.createDataFrame([("Iran", "Asia"), ("Narnia", "West"), (None, "East")], "Country string, Region string")
    got = {r["Country"]: r["Region"] for r in cleaning.apply_region_corrections(df).collect()}
    assert got == {"Iran": "Middle East", "Narnia": "West", None: "East"}
    added = cleaning.apply_region_corrections(df.drop("Region"))
    assert {r["Country"]: r["Region"] for r in added.collect()} == {"Iran": "Middle East", "Narnia": None, None: None}
    assert len(REGION_OF_COUNTRY) == 95 and len(WEATHER_CODES) == 18


def panel_of(spark, rows):
    return spark.createDataFrame(rows, "Country string, Region string, Year int, AvgTemperature double")


def test_trend_edges(spark):
    rows = [
        ("One", "R", 2000, 5.0),
        ("Two", "R", 2000, 5.0), ("Two", "R", 2001, 7.0),
        ("Flat", "R", 2000, 3.0), ("Flat", "R", 2001, 3.0), ("Flat", "R", 2002, 3.0),
        ("Both", "R", 2000, 1.0), ("Both", "S", 2000, 9.0), ("Both", "S", 2001, 8.0),
        (None, "R", 2000, 1.0), ("X", None, 2000, 1.0),
    ]
    yearly = panel.build_yearly(panel_of(spark, rows))
    got = {(r["Country"], r["Region"]): r for r in trends.country_trends(yearly).collect()}
    assert set(got) == {("One", "R"), ("Two", "R"), ("Flat", "R"), ("Both", "R"), ("Both", "S")}
    assert (got["One", "R"]["WarmingTrendPerYear"], got["One", "R"]["VolatilityScore"]) == (0.0, 0.0)
    assert (got["Two", "R"]["WarmingTrendPerYear"], got["Two", "R"]["VolatilityScore"]) == (2.0, None)
    assert (got["Flat", "R"]["HottestYear"], got["Flat", "R"]["VolatilityScore"]) == (2000, 0.0)
    assert got["Both", "S"]["TemperatureChange"] == -1.0
    changes = {(r["Country"], r["Region"], r["Year"]): r["TempChange"] for r in yearly.collect()}
    assert changes["Two", "R", 2001] == 2.0 and changes["Both", "S", 2000] == 0.0


def test_decimal_means_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("a", Decimal("0.1"))] * 10 + [("a", Decimal("1000000.3"))], "k string, v decimal(18,2)")
    assert df.repartition(5).groupBy("k").agg(numbers.mean(F.col("v"))).first()[1] == 1000001.3 / 11


def test_rollup_edges(spark):
    day = dt.date
    rows = [
        ("a", day(2024, 1, 1), 5.0, -5.0, 0.0, 1.0, None, 3.0, 61), ("a", day(2024, 1, 2), 7.0, -7.0, 0.0, None, None, None, 0),
        ("b", day(2024, 1, 1), 10.0, 4.0, None, None, None, None, None), ("b", day(2024, 2, 1), 12.0, 4.0, None, None, 2.0, None, None),
        ("c", day(2024, 1, 5), 1.0, 1.0, None, None, None, None, 77), ("c", day(2024, 2, 6), None, None, 4.0, None, 0.0, None, 77),
    ]
    df = spark.createDataFrame(rows, "location string, day date, tmax double, tmin double, tmean double, precipitation double, rain double, wind double, code int")
    got = {r["location"]: r for r in rollup.rollup(df, "year").collect()}
    assert got["a"]["temperature_c"] == 0.0 and got["a"]["weather_code"] == 0 and got["a"]["condition"] == "clear sky"
    assert got["b"]["temperature_c"] == 7.5 and got["b"]["weather_code"] == 0 and got["b"]["will_rain"]
    assert got["c"]["condition"] == "variable" and got["c"]["num_days"] == 2 and not got["c"]["will_rain"]
    months = {(r["location"], r["month"]): r["avg_temp"] for r in rollup.monthly_means(df).collect()}
    assert months == {("a", "January"): 0.0, ("b", "January"): 10.0, ("b", "February"): 12.0, ("c", "February"): 4.0}


def test_numeric_sort_drops_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None), ("d", 9.0)], "k string, v double")
    assert [r["k"] for r in ranking.sort_numeric(df, "v").collect()] == ["d", "a"]
    assert [r["share"] for r in ranking.with_share(df.where("k in ('a','d')"), "v").orderBy("k").collect()] == [1 / 9 * 100, 100.0]


def test_pages(spark):
    df = spark.range(60)
    ids = lambda n: [r[0] for r in ranking.page(df, [F.desc("id")], n).collect()]
    assert ids(1) == list(range(59, 34, -1)) and ids(0) == ids(1)
    assert ids(3) == list(range(9, -1, -1)) and ids(99) == ids(3)
    assert ranking.page(spark.range(0), [F.desc("id")], 4).collect() == []
    far = ranking.page(spark.range(30_000), [F.asc("id")], 1_000)
    assert [r[0] for r in far.collect()] == list(range(24_975, 25_000))


def test_year_filter_and_questions(spark):
    df = panel_of(spark, [("A", "R", 2000, 1.0), ("B", "R", 2000, 3.0), ("A", "R", 2001, 2.0)])
    assert selection.filter_year(df, 2001).count() == 1 and selection.filter_year(df, 1900).count() == 3
    names = linking.dictionary((df.withColumn("Country", F.concat("Country", F.lit(" land"))), "Country", "Country"))
    lands = df.withColumn("Country", F.concat("Country", F.lit(" land")))
    texts = ["hottest country in 2000", "rows of the latest year", "about a land", "B land in 2000"]
    table = spark.createDataFrame([(q, q) for q in texts], "qid string, text string")
    got = linking.yearly_rows(lands, table, "qid", "text", names).collect()
    asked = lambda q: [(r["Country"], r["Year"]) for r in sorted(got, key=lambda r: r["row_no"]) if r["qid"] == q]
    assert asked("hottest country in 2000") == [("B land", 2000), ("A land", 2000)]
    assert asked("rows of the latest year") == [("A land", 2001)]
    assert sorted(asked("about a land")) == [("A land", 2000), ("A land", 2001)]
    assert asked("B land in 2000") == [("B land", 2000)]
    assert selection.relevant_rows(df, "what is in zzz").count() == 3
    assert [r["Country"] for r in selection.relevant_rows(df, "tell me of b").collect()] == ["B"]


def test_kinds_and_lists(spark):
    df = spark.createDataFrame([("2024-01-05", "x, y", 1, None), ("2024-02-30", "z", 2, None)], "d string, s string, n int, e string")
    kinds = {r["column"]: r["kind"] for r in profile.column_kinds(df).collect()}
    assert kinds == {"d": "categorical", "s": "categorical", "n": "numeric", "e": "date"}
    assert profile.distinct_names(df, "s").first()["names"] == ["x, y", "z"]
    long = spark.range(20_000).select(F.concat(F.repeat(F.lit("n"), 1000), F.col("id").cast("string")).alias("s"))
    assert profile.distinct_values(long, "s").count() == 20_000
    assert profile.distinct_names(long, "s").select(F.size("names")).first()[0] == 20_000


def test_asked_rankings_follow_their_one_limit(spark):
    rows = [(f"C{i:03}", f"R{i % 9}", float(i), float(i)) for i in range(300)]
    countries = spark.createDataFrame(rows, "Country string, Region string, TemperatureChange double, AverageTemperature double")
    regions = countries.groupBy("Region").agg(F.max("TemperatureChange").alias("RegionalTemperatureChange"), F.max("AverageTemperature").alias("AverageRegionalTemperature"))
    asked = spark.createDataFrame([(1, "top 80 hottest countries"), (2, "top 250 hottest countries")], "qid int, text string")
    count = lambda **most: {r["qid"]: r["n"] for r in ranking.answer_rankings(asked, "qid", "text", countries, regions, **most).where("section = 'countries'").groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert count() == {1: 80, 2: 200} and count(most=20) == {1: 20, 2: 20} and count(most=280) == {1: 80, 2: 250}


MARKED = "## Weather - Oslo\n\n**Temperature**: 12 C\nFeels Like: 10\nWind: 5 km/h\n- a bullet\n1. one\n| a | b |\nplain words"


def test_markup(spark):
    df = spark.createDataFrame([(1, MARKED), (2, "nothing here"), (3, None)], "k int, t string")
    types = [r["line_type"] for r in typed_lines(df, "k", "t").where("k = 1").orderBy("line_no").collect()]
    assert types == ["heading", "blank", "label_value", "label_value", "label_value", "bullet", "numbered", "table", "prose"]
    runs = blocks(df, "k", "t").where("k = 1 AND line_type = 'label_value'").collect()
    assert [(r["block_no"], r["first_line"], r["n_lines"]) for r in runs] == [(3, 3, 3)]
    row = weather_fields(df, "k", "t").collect()
    assert len(row) == 1 and (row[0]["loc"], row[0]["temp"], row[0]["feels"], row[0]["wind"], row[0]["rain"]) == (
        "Oslo", "12 C", "10 C", "5 km/h", "-"
    )
    assert label_values(df, "k", "t").count() >= 3
