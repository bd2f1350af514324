"""Linking against brute force over all pairs of a small fixture."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from isotherm.functions.lookups import COUNTRIES_OF_REGION, FACT_ALIASES
from isotherm.operators import linking
from isotherm.plans import reports
from isotherm.operators.trends import country_order

NAMES = [c for names in COUNTRIES_OF_REGION.values() for c in names] + list(COUNTRIES_OF_REGION)
TEXTS = [
    "Compare Saudi Arabia and the Untied Kingdom", "south koria vs. North Korea", "usa or uk?", "Oman is not Romania",
    "papua new guinee, trinidad & tobago", "costa rca / el salvadr", "Dominican Republik and czech republic", "U.S. states",
    "the united arab emirats", "new zeeland in oceania", "sri lanka; Sri  Lanka", "", "éthiopie", "midle east or soth america",
    "untied staets of americ", "Viet nam, indonesa", "a", "saudi arab", "kingdom united", "trinidad and tobego islands",
]


def normal(s):
    return " ".join(re.sub(r"[^a-zA-Z0-9\s]", " ", s.lower()).split())


def ascii_lower(s):
    return " ".join(re.sub(r"[^a-z0-9]+", " ", s.lower()).split())


@pytest.fixture(scope="module")
def tables(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "qid int, text string").repartition(3)
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return texts, linking.dictionary((names, "name", "Place"))


def test_mentions(tables):
    texts, names = tables
    got = {(r["qid"], r["name"]) for r in linking.mentions(texts, "qid", "text", names).collect()}
    want = {(i, n) for i, t in enumerate(TEXTS) for n in NAMES if f" {ascii_lower(n)} " in f" {ascii_lower(t)} "}
    assert got == want and (3, "Romania") in got and (3, "Oman") in got


def test_more_names_than_a_list_should_hold(spark):
    """Dictionaries have no bound: over ten thousand names, exact and misspelt ones."""
    made = spark.range(12_000).select(F.concat(F.lit("place number "), F.lpad(F.col("id").cast("string"), 6, "x")).alias("name"))
    names = linking.dictionary((made, "name", "Place"))
    texts = spark.createDataFrame([(0, "to place number x11999"), (1, "to plase number xx1234"), (2, "to place of no number")], "qid int, text string")
    flags = {r["qid"]: r["names_place"] for r in linking.names_place(texts, "qid", "text", names).collect()}
    assert flags == {0: True, 1: True, 2: False}


def test_aliases(tables):
    texts, names = tables
    got = {(r["qid"], r["name"]) for r in linking.mentions(texts, "qid", "text", names, FACT_ALIASES).collect()}
    assert {(2, "United States"), (2, "United Kingdom"), (7, "United States")} <= got


@pytest.mark.parametrize("threshold,measure,exact_single", [
    (0.88, "ratio", True), (0.82, "ratio", False), (0.6, "ratio", False), (0.82, "levenshtein", True), (0.7, "levenshtein", False),
])
def test_fuzzy_loses_no_pair(tables, threshold, measure, exact_single):
    texts, names = tables
    hits = linking.fuzzy_mentions(texts, "qid", "text", names, threshold, measure, exact_single)
    got = {(r["qid"], r["name"]) for r in hits.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i] + [0] * len(b), row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    def similarity(name, phrase):
        if measure == "ratio":
            return SequenceMatcher(None, name, phrase).ratio()
        return 1 - distance(name, phrase) / max(len(name), len(phrase))

    want = set()
    for i, t in enumerate(TEXTS):
        tokens = ascii_lower(t).split()
        for n in NAMES:
            phrase = ascii_lower(n)
            k = len(phrase.split())
            if exact_single and k == 1:
                continue
            if any(similarity(phrase, " ".join(tokens[p:p + k])) >= threshold for p in range(len(tokens) - k + 1)):
                want.add((i, n))
    assert got == want and want


def rows_of(spark):
    data = [(c, r, float(i % 7), float(i % 3)) for r, names in COUNTRIES_OF_REGION.items() for i, c in enumerate(names)]
    return spark.createDataFrame(data, "Country string, Region string, TemperatureChange double, WarmingTrendPerYear double")


def test_pick_rows(spark):
    rows = rows_of(spark)
    names = linking.dictionary((rows, "Country", "Country"), (rows, "Region", "Region"))
    asked = ["Oman in Asia", "rows of Oceania and Asia", "zealand", "nothing of note", "saudi arabbia"]
    texts = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    got = linking.pick_rows(texts, "qid", "text", rows, names, country_order(), max_rows=5).collect()
    by = lambda q: sorted((r["row_no"], r["Country"], r["phase"]) for r in got if r["qid"] == q)
    assert by(0) == [(1, "Oman", 1)]
    ordered = sorted(rows.collect(), key=lambda r: (-r["TemperatureChange"], -r["WarmingTrendPerYear"], r["Region"], r["Country"]))
    chosen = [r["Country"] for r in ordered if r["Region"] in ("Oceania", "Asia")][:5]
    assert by(1) == [(i + 1, c, 2) for i, c in enumerate(chosen)]
    assert by(2) == [(1, "New Zealand", 3)]
    assert by(3) == [(i + 1, r["Country"], 4) for i, r in enumerate(ordered[:5])]
    assert by(4) == [(1, "Saudi Arabia", 1)]


def test_match_countries(spark):
    rows = rows_of(spark)
    places = spark.createDataFrame([("USA",), ("Korea",), ("New York",), ("zz",), (None,)], "p string")
    got = {(r["place"], r["Country"]): r["score"] for r in linking.match_countries(places, "p", rows).collect()}
    assert got["USA", "United States"] == 100 and got["Korea", "South Korea"] == 50 and got["New York", "New Zealand"] == 10
    assert not any(p == "zz" for p, _ in got)


def test_comparison_needs_two(spark):
    rows = rows_of(spark)
    for c in ("FirstYear", "LatestYear", "FirstTemperature", "LatestTemperature", "AverageTemperature", "VolatilityScore"):
        rows = rows.withColumn(c, F.lit(1.0))
    regions = rows.select("Region").distinct()
    for c in reports.REGION_METRICS:
        regions = regions.withColumn(c, F.lit(1.0))
    names = linking.dictionary((rows, "Country", "Country"), (rows, "Region", "Region"))
    texts = spark.createDataFrame([(0, "usa vs uk vs Peru"), (1, "only Peru"), (2, "Asia, Africa")], "qid int, text string")
    got = reports.comparison(texts, "qid", "text", names, rows, regions).collect()
    assert {r["entity"] for r in got if r["section"] == "difference"} == {
        "United Kingdom vs United States", "United Kingdom vs Peru", "United States vs Peru"
    }
    assert {r["qid"] for r in got} == {0, 2}


def test_long_texts_are_scored_by_a_short_key(spark, monkeypatch):
    """Neither what is ranked nor what is written repeats the words of a text; equal texts share their rows, a text of no name gets the first."""
    written, write = {}, linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, name="table": written.setdefault(name, write(df, name)))
    rows = spark.createDataFrame([("Peru", "A"), ("Peru", "B"), ("Chad", "A")], "Country string, Region string")
    long = "xyz " * 500 + "peru per"
    texts = spark.createDataFrame([(1, long), (2, long), (3, "qq"), (4, None), (5, "chad " * 3)], "qid int, text string")
    got = linking.keyword_rows(texts, "qid", "text", rows, "Country", [F.asc("Country"), F.asc("Region")], fallback=1)
    expected = [(i, 2, n, "Peru", r) for i in (1, 2) for n, r in ((1, "A"), (2, "B"))] + [(3, 0, 1, "Chad", "A"), (4, 0, 1, "Chad", "A"), (5, 3, 1, "Chad", "A")]
    assert sorted(map(tuple, got.select("qid", "score", "row_no", "Country", "Region").collect())) == expected
    widest = lambda df: df.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert widest(written["scored"]) < 200 and widest(written["told"]) < 200


def test_questions_are_read_once_for_their_year_and_ranking(spark, monkeypatch):
    written, write = [], linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, name="table": written.append((name, df.columns)) or write(df, name))
    yearly = spark.createDataFrame([("Saudi Arabia", "Asia", 1999, 30.0), ("Peru", "South America", 2000, 20.0)], "Country string, Region string, Year int, AvgTemperature double")
    names = linking.dictionary((yearly, "Country", "Country"), (yearly, "Region", "Region"))
    texts = spark.createDataFrame([(1, "hottest of 1999"), (2, "about peru"), (3, "saudi arabbia 1999"), (4, None)], "qid int, text string")
    got = linking.yearly_rows(yearly, texts, "qid", "text", names)
    assert sorted((r["qid"], r["Country"]) for r in got.collect()) == [(1, "Saudi Arabia"), (2, "Peru"), (3, "Saudi Arabia"), (4, "Peru"), (4, "Saudi Arabia")]
    assert ("asked", ["qid", "_low", "_ranked", "_part"]) in written
