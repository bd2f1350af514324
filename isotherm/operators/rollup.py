"""Daily observations to day / month / year summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.lookups import WEATHER_CODES, lookup_table
from isotherm.functions.numbers import exact, round_to

# How a day is written at each grain.
PERIOD_FORMAT = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def with_condition(df: DataFrame, code: str, name: str = "condition", default: str = "unknown") -> DataFrame:
    """The text of a weather code, or ``default``."""
    texts = lookup_table(df.sparkSession, WEATHER_CODES, f"{code} int, _text string")
    joined = df.join(F.broadcast(texts), code, "left")  # 18 fixed rows
    return joined.withColumn(name, F.coalesce("_text", F.lit(default))).select(*df.columns, name)


def will_rain(rain: Column, probability: Column | None = None) -> Column:
    wet = F.coalesce(rain > 0, F.lit(False))
    return wet if probability is None else wet | F.coalesce(probability >= 50, F.lit(False))


def _ratio(total: str, count: str) -> Column:
    return F.try_divide(F.sum(total).cast("double"), F.sum(count).cast("double"))


MEANS = {"tmean": "mean", "tmax": "max", "tmin": "min", "wind": "wind"}
TOTALS = ["days", *[f"{n}_{kind}" for n in MEANS.values() for kind in ("sum", "n")], "rain", "precipitation"]
PARTS = [*TOTALS, "highest", "lowest"]


def day_parts() -> list[Column]:
    """A daily row as the parts a period is put together from."""
    return [
        F.lit(1).cast("bigint").alias("days"),
        *[exact(F.col(c), 6).alias(f"{n}_sum") for c, n in MEANS.items()],
        *[F.col(c).isNotNull().cast("bigint").alias(f"{n}_n") for c, n in MEANS.items()],
        F.col("tmax").alias("highest"),
        F.col("tmin").alias("lowest"),
        exact(F.col("rain"), 6).alias("rain"),
        exact(F.col("precipitation"), 6).alias("precipitation"),
    ]


def merged_parts() -> list[Column]:
    """Parts of days, or of shorter periods, put together."""
    return [*[F.sum(c).alias(c) for c in TOTALS], F.max("highest").alias("highest"), F.min("lowest").alias("lowest")]


def summary() -> list[Column]:
    """The summary of a period from its parts per code."""
    mean_of = lambda n: round_to(_ratio(f"{n}_sum", f"{n}_n"), 2)
    code = F.max_by("code", F.when(F.col("code").isNotNull(), F.struct("days", -F.col("code"))))
    return [
        F.coalesce(mean_of("mean"), round_to((mean_of("max") + mean_of("min")) / 2, 2)).alias("temperature_c"),
        round_to(F.max("highest"), 2).alias("max_temperature_c"),
        round_to(F.min("lowest"), 2).alias("min_temperature_c"),
        round_to(F.sum("rain"), 2).alias("rain_mm"),
        round_to(F.sum("precipitation"), 2).alias("precipitation_mm"),
        mean_of("wind").alias("wind_speed_kmh"),
        F.sum("days").alias("num_days"),
        F.coalesce(code, F.lit(0)).alias("weather_code"),
    ]


def described(summaries: DataFrame) -> DataFrame:
    """With the text of the code and whether it rains."""
    return with_condition(summaries, "weather_code", default="variable").withColumn("will_rain", will_rain(F.col("rain_mm")))


def rollup(daily: DataFrame, grain: str) -> DataFrame:
    """Mean of means, highest max, lowest min, totals, mean wind, days and dominant code.

    Counting per code and summing share the first aggregation; the second one
    only merges its few rows per period, so no join is needed for the code.
    """
    period = F.date_format("day", PERIOD_FORMAT[grain])
    parts = daily.select("location", period.alias("period"), "code", *day_parts())
    first = parts.groupBy("location", "period", "code").agg(*merged_parts())
    return described(first.groupBy("location", "period").agg(*summary()))


def dominant_code(daily: DataFrame, grain: str) -> DataFrame:
    """The most frequent code per location and period; the smallest one on ties."""
    period = F.date_format("day", PERIOD_FORMAT[grain])
    counts = daily.where("code IS NOT NULL").groupBy("location", period.alias("period"), "code").count()
    best = F.max(F.struct("count", (-F.col("code")).alias("code")))
    return counts.groupBy("location", "period").agg(best.alias("_b")).select(
        "location", "period", (-F.col("_b.code")).alias("weather_code"), F.col("_b.count").alias("n_days")
    )


def monthly_means(daily: DataFrame) -> DataFrame:
    """Mean temperature per month of each year; from the maxima if a year has no means."""
    sums = daily.groupBy(
        "location", F.year("day").alias("year"), F.month("day").alias("month_no")
    ).agg(
        F.sum(exact(F.col("tmean"), 6)).alias("mean_sum"),
        F.count("tmean").alias("mean_n"),
        F.sum(exact(F.col("tmax"), 6)).alias("max_sum"),
        F.count("tmax").alias("max_n"),
    )
    year = W.partitionBy("location", "year")  # at most twelve rows
    by_mean = F.sum("mean_n").over(year) > 0
    total = F.when(by_mean, F.col("mean_sum")).otherwise(F.col("max_sum")).cast("double")
    count = F.when(by_mean, F.col("mean_n")).otherwise(F.col("max_n")).cast("double")
    return (
        sums.select("location", "year", "month_no", total.alias("_t"), count.alias("_c"))
        .where("_c > 0")
        .select(
            "location",
            "year",
            "month_no",
            F.date_format(F.make_date("year", "month_no", F.lit(1)), "MMMM").alias("month"),
            round_to(F.col("_t") / F.col("_c"), 2).alias("avg_temp"),
        )
    )
