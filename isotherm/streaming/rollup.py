"""Daily, monthly and yearly summaries of a stream of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.numbers import exact, round_to
from isotherm.operators.rollup import PARTS, PERIOD_FORMAT, day_parts, described, merged_parts, summary

# What a reading may hold besides its location, time and temperature; what it lacks is null.
MEASURES = {"rain": "double", "precipitation": "double", "wind": "double", "code": "int"}


def _days(readings: DataFrame, lateness: str) -> DataFrame:
    """One row per location and day: ``w, location, n, tmean, tmax, tmin, rain, precipitation, wind, code``.

    Mean, highest and lowest temperature, total rain and precipitation, strongest wind and highest code.
    """
    lacking = {c: F.lit(None).cast(t) for c, t in MEASURES.items() if c not in readings.columns}
    # Windows are cut at midnight UTC: shift to local wall-clock time and, for what is shown, back.
    wall = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    rows = readings.withColumns({**lacking, "ts": wall})
    rows = rows.withWatermark("ts", lateness) if readings.isStreaming else rows
    days = rows.groupBy(F.window("ts", "1 day").alias("w"), "location").agg(
        F.sum(exact(F.col("value"), 6)).alias("total"),
        F.count("value").alias("n"),
        F.max("value").alias("tmax"),
        F.min("value").alias("tmin"),
        F.sum(exact(F.col("rain"), 6)).alias("rain"),
        F.sum(exact(F.col("precipitation"), 6)).alias("precipitation"),
        F.max("wind").alias("wind"),
        F.max("code").alias("code"),
    )
    tmean = round_to(F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")), 2)
    return days.withColumn("tmean", tmean).drop("total")


def _shown(at: str) -> Column:
    return F.to_utc_timestamp(at, F.current_timezone())


def _by_code(parts: DataFrame, grain: str) -> DataFrame:
    """Parts per location, period and code, each closed when the watermark passes the end of its period.

    Months and years have no fixed length, so a period is a session: every row reaches from its time ``at`` to the
    end of its period, and thus into all others of it. ``at`` of what comes out is the last instant of the period.
    """
    shown = _shown("at")
    end = F.from_utc_timestamp(F.date_trunc(grain, shown) + F.expr(f"INTERVAL 1 {grain}"), F.current_timezone())
    gap = F.concat((F.unix_micros(end) - F.unix_micros("at")).cast("string"), F.lit(" microseconds"))
    dated = parts.withColumns({"period": F.date_format(shown, PERIOD_FORMAT[grain]), "gap": gap})
    closed = dated.groupBy("location", "period", "code", F.session_window("at", F.col("gap")).alias("w")).agg(*merged_parts())
    return closed.select(F.window_time("w").alias("at"), "location", "period", "code", *PARTS)


def daily_summaries(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Temperatures, rain, precipitation, wind, code and number of readings per location and day.

    A day is emitted once the watermark has passed its end; readings that come
    later than that are dropped. Works on a batch table as well. State is one
    small row per location and open day, kept per task before the shuffle.
    """
    days = _days(readings, lateness).select(
        "location",
        F.date_format(_shown("w.start"), PERIOD_FORMAT["day"]).alias("day"),
        F.col("tmean").alias("temperature_c"),
        F.col("tmax").alias("max_temperature_c"),
        F.col("tmin").alias("min_temperature_c"),
        "n",
        round_to(F.col("rain").cast("double"), 2).alias("rain_mm"),
        round_to(F.col("precipitation").cast("double"), 2).alias("precipitation_mm"),
        round_to(F.col("wind"), 2).alias("wind_speed_kmh"),
        F.lit(1).cast("bigint").alias("num_days"),
        F.coalesce("code", F.lit(0)).alias("weather_code"),
    )
    return described(days)


def period_summaries(readings: DataFrame, grain: str, lateness: str = "1 hour") -> DataFrame:
    """The summary of ``operators.rollup.rollup`` per location and ``month`` or ``year``.

    Chained aggregations of one stream under one watermark: days feed months, months feed years. A period is emitted
    once, when the watermark has passed its end; what comes later for one of its days is dropped. State is a row per
    location and open day, and one per location, open period and code. Works on a batch table as well.
    """
    days = _days(readings, lateness).withColumn("at", F.window_time("w"))
    parts = _by_code(days.select("at", "location", "code", *day_parts()), "month")
    if grain == "year":
        parts = _by_code(parts.drop("period"), "year")
    return described(parts.groupBy("location", "period", "at").agg(*summary()).drop("at"))
