"""Composite reports: tagged long tables built from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.lookups import COMPARE_ALIASES, FACT_ALIASES
from isotherm.functions.numbers import round_to
from isotherm.operators import profile, ranking, selection
from isotherm.operators.compare import pair_differences
from isotherm.operators.linking import linked_names, mentions
from isotherm.operators.panel import build_yearly, yearly_means
from isotherm.operators.trends import (
    country_order,
    country_trends,
    fastest_warming_regions,
    hottest_countries,
    regional_trends,
)
from isotherm.session import materialize

COUNTRY_METRICS = [
    "FirstYear", "LatestYear", "FirstTemperature", "LatestTemperature", "AverageTemperature",
    "TemperatureChange", "WarmingTrendPerYear", "VolatilityScore",
]
REGION_METRICS = [
    "FirstYear", "LatestYear", "FirstRegionalTemperature", "LatestRegionalTemperature",
    "AverageRegionalTemperature", "RegionalTemperatureChange", "RegionalWarmingTrendPerYear",
    "RegionalVolatilityScore",
]


def build_bundle(panel: DataFrame) -> dict[str, DataFrame]:
    """The five result tables of a panel; the yearly table is computed once."""
    yearly = materialize(build_yearly(panel))
    countries, regions = country_trends(yearly), regional_trends(yearly)
    return {
        "yearly": yearly,
        "country_trends": countries,
        "regional_trends": regions,
        "fastest_regions": fastest_warming_regions(regions),
        "hottest_countries": hottest_countries(countries),
    }


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _top(df: DataFrame, section: str, entity: str, metric: str, ascending: bool, n: int, ties) -> DataFrame:
    order = [F.asc(metric) if ascending else F.desc(metric), *[F.asc(t) for t in ties]]
    return ranking.ranked(df.where(F.col(metric).isNotNull()), order, n).select(
        F.lit(section).alias("section"), "rank", F.col(entity).alias("entity"),
        F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"),
    )


def country_rankings(countries: DataFrame, n: int) -> DataFrame:
    """Hottest, coolest, fastest warming, cooling and most stable countries."""
    ties = ["Region", "Country"]
    return union([
        _top(countries, "hottest", "Country", "AverageTemperature", False, n, ties),
        _top(countries, "coolest", "Country", "AverageTemperature", True, n, ties),
        _top(countries, "fastest", "Country", "TemperatureChange", False, n, ties),
        _top(selection.cooling(countries), "cooling", "Country", "TemperatureChange", True, n, ties),
        _top(countries, "most_stable", "Country", "VolatilityScore", True, n, ties),
    ])


def region_rankings(regions: DataFrame, n: int) -> DataFrame:
    return union([
        _top(regions, "hottest", "Region", "AverageRegionalTemperature", False, n, ["Region"]),
        _top(regions, "fastest", "Region", "RegionalTemperatureChange", False, n, ["Region"]),
    ])


def year_extremes(yearly: DataFrame, year: int, n: int) -> DataFrame:
    """Hottest and coldest countries of one year."""
    rows = yearly.where(F.col("Year") == year)
    ties = ["Country", "Region"]
    return union([
        _top(rows, "hottest", "Country", "AvgTemperature", False, n, ties),
        _top(rows, "coldest", "Country", "AvgTemperature", True, n, ties),
    ])


def _long(df: DataFrame, section: str, key: str | None, entity: str, metrics: list[str]) -> DataFrame:
    """Metric rows of a table: one row per entity and metric."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    keys = [F.col(key)] if key else []
    return df.select(*keys, F.lit(section).alias("section"), F.col(entity).alias("entity"), F.inline(pairs))


def dataset_facts(yearly: DataFrame, countries: DataFrame, regions: DataFrame, n: int, year: int | None = None) -> DataFrame:
    """Year block, metadata, statistics, global series and all rankings as one long table.

    Feed it materialized tables: every part reads them again.
    """
    blank = lambda df, section: df.select(F.lit(section).alias("section"), F.lit(0).alias("rank"), "entity", "metric", "value")
    one = lambda df, section, metrics: blank(_long(df.withColumn("entity", F.lit("all")), section, None, "entity", metrics), section)
    parts = []
    if year is not None:
        parts.append(one(profile.year_summary(yearly, year), "year", ["n_rows", "GlobalAverage"]))
        extremes = year_extremes(yearly, year, n)
        parts.append(extremes.withColumn("section", F.concat(F.lit("year_"), F.col("section"))))
    parts.append(one(profile.table_metadata(yearly), "metadata", ["n_rows", "n_countries", "n_regions", "n_years", "first_year", "last_year"]))
    parts.append(one(profile.column_statistics(yearly, "AvgTemperature"), "statistics", ["mean", "median", "min", "max", "std", "range"]))
    parts.append(one(profile.global_summary(yearly), "global", ["first_average", "latest_average", "change", "hottest_year", "coldest_year"]))
    series = profile.last_periods(yearly, 12).select(
        F.col("Year").cast("string").alias("entity"), F.lit("GlobalAverage").alias("metric"),
        round_to(F.col("GlobalAverage"), 3).alias("value"),
    )
    parts.append(blank(series, "series"))
    latest = selection.latest_year_rows(yearly)
    parts.append(_top(latest, "latest_hottest", "Country", "AvgTemperature", False, 1, ["Country", "Region"]))
    parts.append(country_rankings(countries, n).withColumn("section", F.concat(F.lit("country_"), F.col("section"))))
    parts.append(region_rankings(regions, n).withColumn("section", F.concat(F.lit("region_"), F.col("section"))))
    return union(parts)


def matched_facts(
    questions: DataFrame, key: str, text: str, names: DataFrame, countries: DataFrame, regions: DataFrame,
    measure: str = "ratio",
) -> DataFrame:
    """Metric rows of the places each question names, and the differences of its first four countries."""
    linked = materialize(linked_names(questions, key, text, names, measure=measure, aliases=FACT_ALIASES))
    named = linked.where("kind = 'Country'").select(key, "name")
    rows = named.join(countries, F.col("name") == F.col("Country"))
    regional = linked.where("kind = 'Region'").join(regions, F.col("name") == F.col("Region"))
    pairs = pair_differences(named, key, countries, country_order(), first=4)
    pairs = pairs.withColumn("entity", F.concat_ws(" vs ", "a", "b"))
    return union([
        _long(rows, "country", key, "Country", COUNTRY_METRICS),
        _long(regional, "region", key, "Region", REGION_METRICS),
        _long(pairs, "difference", key, "entity", ["avg_diff", "latest_diff", "change_diff"]),
    ])


def comparison(
    questions: DataFrame, key: str, text: str, names: DataFrame, countries: DataFrame, regions: DataFrame
) -> DataFrame:
    """Metric rows and differences of the countries a question names (two or more), and of its regions.

    The names of a question are collected once per kind; the number of its pairs is the square of that few.
    """
    found = mentions(questions, key, text, names, COMPARE_ALIASES)
    listed = found.groupBy(key, "kind").agg(F.collect_set("name").alias("_names")).where(F.size("_names") >= 2)
    named = listed.select(key, "kind", F.explode_outer("_names").alias("name"))
    of = lambda kind: named.where(F.col("kind") == kind)
    rows = of("Country").join(countries, F.col("name") == F.col("Country"))
    regional = of("Region").join(regions, F.col("name") == F.col("Region"))
    longest_first: list[Column] = [F.desc(F.length("Country")), F.asc("Country")]
    pairs = pair_differences(of("Country"), key, countries, longest_first, by=[key, "kind"])
    return union([
        _long(rows, "country", key, "Country", COUNTRY_METRICS),
        _long(regional, "region", key, "Region", REGION_METRICS),
        _long(pairs.withColumn("entity", F.concat_ws(" vs ", "a", "b")), "difference", key, "entity", ["avg_diff", "latest_diff", "change_diff", "trend_diff"]),
    ])


def place_profile(
    observations: DataFrame, key: str, country: str, temperature: str,
    yearly: DataFrame, countries: DataFrame, regions: DataFrame,
) -> DataFrame:
    """Reading, trend rows of its country and region, and the last five years of the country.

    The profile of a country is put together once and joined to the readings, so
    a country with many readings costs one hash lookup per reading.
    """
    trend = _long(countries, "country", None, "Country", COUNTRY_METRICS).select(
        F.col("entity").alias("Country"), "section", "entity", "metric", "value"
    )
    by_region = countries.select("Country", "Region").join(regions, "Region")
    regional = _long(by_region.withColumn("entity", F.col("Region")), "region", "Country", "entity", REGION_METRICS)
    years = ranking.latest_rows(yearly, 5).select(
        "Country", F.lit("yearly").alias("section"), F.col("Year").cast("string").alias("entity"),
        F.lit("AvgTemperature").alias("metric"), F.col("AvgTemperature").alias("value"),
    )
    profiles = materialize(union([trend, regional, years]).withColumn("_name", F.lower("Country")).drop("Country"))
    asked = observations.select(key, F.lower(F.col(country)).alias("_name"), F.col(temperature).cast("double").alias("value"))
    reading = asked.select(
        key, F.lit("observation").alias("section"), F.col("_name").alias("entity"),
        F.lit("temperature_c").alias("metric"), "value",
    )
    found = asked.select(key, "_name").join(profiles, "_name").drop("_name")
    return reading.unionByName(found.select(*reading.columns))
