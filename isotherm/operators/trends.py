"""Trend tables: one reducer for countries and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.numbers import exact, mean, round_to, slope
from isotherm.operators.panel import regional_means


def country_order() -> list[Column]:
    """Largest change first, then steepest slope."""
    return [F.desc("TemperatureChange"), F.desc("WarmingTrendPerYear"), F.asc("Region"), F.asc("Country")]


def region_order() -> list[Column]:
    return [F.desc("RegionalTemperatureChange"), F.desc("RegionalWarmingTrendPerYear"), F.asc("Region")]


def trend_metrics(df: DataFrame, keys: list[str], value: str, digits: int) -> DataFrame:
    """First and latest value, change, mean, slope, volatility and peak per group.

    ``df`` has one row per group and Year, and ``value`` counts to ``digits`` decimals,
    so that sums are exact and do not depend on the order of the rows. The lag window and the aggregation are
    clustered on the same keys and share one shuffle.
    """
    by_year = W.partitionBy(*keys).orderBy("Year")
    v = F.col(value)
    stepped = df.withColumn("_step", v - F.lag(v).over(by_year))
    first, latest = F.min_by(v, F.col("Year")), F.max_by(v, F.col("Year"))
    trend = slope(v, F.col("Year"), digits)
    volatility = F.when(F.count("_step") == 0, 0.0).otherwise(F.stddev_samp("_step"))
    return stepped.groupBy(*keys).agg(
        F.min("Year").alias("first_year"),
        F.max("Year").alias("latest_year"),
        round_to(first, 3).alias("first"),
        round_to(latest, 3).alias("latest"),
        round_to(mean(exact(v, digits)), 3).alias("average"),
        round_to(latest - first, 3).alias("change"),
        round_to(trend, 4).alias("slope"),
        round_to(volatility, 4).alias("volatility"),
        F.max_by("Year", F.struct(v, -F.col("Year"))).alias("peak_year"),
        round_to(F.max(v), 3).alias("peak"),
    )


def country_trends(yearly: DataFrame) -> DataFrame:
    return trend_metrics(yearly, ["Region", "Country"], "AvgTemperature", 3).select(
        "Region",
        "Country",
        F.col("first_year").alias("FirstYear"),
        F.col("latest_year").alias("LatestYear"),
        F.col("first").alias("FirstTemperature"),
        F.col("latest").alias("LatestTemperature"),
        F.col("average").alias("AverageTemperature"),
        F.col("change").alias("TemperatureChange"),
        F.col("slope").alias("WarmingTrendPerYear"),
        F.col("volatility").alias("VolatilityScore"),
        F.col("peak_year").alias("HottestYear"),
        F.col("peak").alias("HottestTemperature"),
    )


def regional_trends(yearly: DataFrame) -> DataFrame:
    """The same metrics over the region means, without the peak."""
    return trend_metrics(regional_means(yearly), ["Region"], "RegionalAverageTemperature", 9).select(
        "Region",
        F.col("first_year").alias("FirstYear"),
        F.col("latest_year").alias("LatestYear"),
        F.col("first").alias("FirstRegionalTemperature"),
        F.col("latest").alias("LatestRegionalTemperature"),
        F.col("average").alias("AverageRegionalTemperature"),
        F.col("change").alias("RegionalTemperatureChange"),
        F.col("slope").alias("RegionalWarmingTrendPerYear"),
        F.col("volatility").alias("RegionalVolatilityScore"),
    )


def fastest_warming_regions(regional: DataFrame, n: int = 5) -> DataFrame:
    return regional.orderBy(*region_order()).limit(n)


def hottest_countries(trends: DataFrame, n: int = 10) -> DataFrame:
    order = [F.desc("LatestTemperature"), F.desc("AverageTemperature"), *country_order()]
    return trends.orderBy(*order).limit(n)
