"""The yearly panel: one row per country, region and year with derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.numbers import exact, mean, rint_to

ENTITY = ["Region", "Country"]


def yearly_means(panel: DataFrame) -> DataFrame:
    """Mean per country, region and year, rounded to three decimals.

    Partial aggregation runs before the shuffle, so a country that holds a large
    share of the rows sends one row per task and year.
    """
    known = panel.where("Country IS NOT NULL AND Region IS NOT NULL AND Year IS NOT NULL")
    return known.groupBy("Country", "Region", "Year").agg(
        rint_to(mean(F.col("AvgTemperature")), 3).alias("AvgTemperature")
    )


def regional_means(yearly: DataFrame) -> DataFrame:
    """Mean of the country means per region and year; exact, as the inputs have three decimals."""
    return yearly.groupBy("Region", "Year").agg(
        mean(exact(F.col("AvgTemperature"))).alias("RegionalAverageTemperature")
    )


def with_changes(yearly: DataFrame) -> DataFrame:
    """Change to the year before, first value and change since it, per country.

    The window holds one row per distinct year of a country.
    """
    by_year = W.partitionBy(*ENTITY).orderBy("Year")
    v = F.col("AvgTemperature")
    baseline = F.first(v, ignorenulls=True).over(
        by_year.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return yearly.withColumns(
        {
            "TempChange": F.coalesce(v - F.lag(v).over(by_year), F.lit(0.0)),
            "BaselineTemperature": baseline,
            "TotalTempChange": v - baseline,
        }
    )


def regional_changes(regional: DataFrame) -> DataFrame:
    by_year = W.partitionBy("Region").orderBy("Year")
    v = F.col("RegionalAverageTemperature")
    return regional.withColumn("RegionalTempChange", F.coalesce(v - F.lag(v).over(by_year), F.lit(0.0)))


def build_yearly(panel: DataFrame) -> DataFrame:
    """The nine-column yearly table."""
    means = yearly_means(panel)
    regional = regional_changes(regional_means(means))
    return with_changes(means).join(regional, ["Region", "Year"], "left").select(
        "Country", "Region", "Year", "AvgTemperature", "TempChange", "BaselineTemperature",
        "TotalTempChange", "RegionalAverageTemperature", "RegionalTempChange",
    )
