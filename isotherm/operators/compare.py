"""Differences between the entities a question names, and joins of readings with history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.numbers import round_to

# The compared metrics.
METRICS = {
    "avg_diff": "AverageTemperature",
    "latest_diff": "LatestTemperature",
    "change_diff": "TemperatureChange",
    "trend_diff": "WarmingTrendPerYear",
}


def pair_differences(
    named: DataFrame, key: str, trends: DataFrame, order: list[Column], first: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """Metric differences of the countries that one question names, as ``key, a, b, ...``.

    ``named`` is ``key, name``. A question's countries are numbered and listed in one row, and the pairs are taken
    from that list: as many as the square of the names its own text holds. With ``first`` only its first names
    count. ``by`` are the columns ``named`` is partitioned by already, if any; they save the shuffle.
    """
    keys = by or [key]
    metrics = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in METRICS.values()]
    rows = named.select(*keys, F.col("name").alias("Country")).join(trends.select("Region", "Country", *metrics), "Country")
    rows = rows.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if first is not None:
        rows = rows.where(F.col("_no") <= first)
    entry = F.struct("_no", "Country", *METRICS.values())
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    rest = lambda i: F.slice("_all", i + 2, F.size("_all"))
    pairs = F.flatten(F.transform("_all", lambda a, i: F.transform(rest(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = listed.select(key, F.explode_outer(pairs).alias("_p")).where("_p IS NOT NULL")
    return each.select(
        key,
        F.col("_p.a.Country").alias("a"),
        F.col("_p.b.Country").alias("b"),
        *[round_to(F.col(f"_p.a.{c}") - F.col(f"_p.b.{c}"), 3).alias(name) for name, c in METRICS.items()],
    )


def with_country_trends(observations: DataFrame, country: str, trends: DataFrame) -> DataFrame:
    """Left join of readings with the trend row of their country, ignoring case.

    ``trends`` should be a written table: the optimizer then knows its size and broadcasts it if it is small.
    """
    known = trends.withColumn("_name", F.lower("Country")).withColumnRenamed("Country", "MatchedCountry").drop("Region")
    named = observations.withColumn("_name", F.lower(F.col(country)))
    return named.join(known, "_name", "left").drop("_name")


def against_history(
    observations: DataFrame, country: str, temperature: str, trends: DataFrame
) -> DataFrame:
    """Current reading, historical average and their difference.

    ``trends`` should be a written table: the optimizer then knows its size and broadcasts it if it is small.
    """
    known = trends.select(F.lower("Country").alias("_name"), F.col("AverageTemperature").alias("historical_avg"))
    joined = observations.withColumn("_name", F.lower(F.col(country))).join(
        known, "_name", "left"
    )
    return joined.withColumn("difference", round_to(F.col(temperature) - F.col("historical_avg"), 3)).drop("_name")
