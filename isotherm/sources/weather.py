"""Landed weather responses to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.lookups import WEATHER_CODES, map_column
from isotherm.functions.numbers import parse_number
from isotherm.operators.rollup import will_rain
from isotherm.schemas import ARCHIVE, FORECAST, STATION

# Archive metric of each column of the daily table.
ARCHIVE_METRICS = {
    "tmax": "temperature_2m_max", "tmin": "temperature_2m_min", "tmean": "temperature_2m_mean",
    "precipitation": "precipitation_sum", "rain": "rain_sum", "wind": "wind_speed_10m_max",
    "code": "weather_code",
}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).json(path)


def parse_archive(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, ARCHIVE).alias("r")).select("r.*")


def archive_days(responses: DataFrame) -> DataFrame:
    """One row per location and day from the parallel arrays; values stay with their day."""
    daily = F.arrays_zip(
        F.col("daily.time").alias("time"),
        *[F.col(f"daily.{m}").alias(c) for c, m in ARCHIVE_METRICS.items()],
    )
    return responses.select(F.col("location.name").alias("location"), F.explode_outer(daily).alias("d")).where("d IS NOT NULL").select(
        "location",
        F.col("d.time").try_cast("date").alias("day"),
        *[F.col(f"d.{c}").alias(c) for c in ARCHIVE_METRICS],
    )


def _record(place: str, timezone, date, current: dict, today: dict) -> list[Column]:
    pack = lambda fields: F.struct(*[c.alias(n) for n, c in fields.items()])
    at = {n: F.col(f"{place}.{n}") for n in ("name", "country", "admin1", "latitude", "longitude")}
    return [
        pack({**at, "timezone": timezone}).alias("location"),
        date.alias("date"),
        pack(current).alias("current"),
        pack(today).alias("today"),
    ]


def _text(code: Column) -> Column:
    return F.coalesce(map_column(WEATHER_CODES, code), F.lit("unknown"))


def forecast_records(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Observation records from responses with numbers and one-element daily arrays."""
    rows = df.select(*keys, F.from_json(column, FORECAST).alias("r")).where("r.current IS NOT NULL AND r.daily IS NOT NULL")
    now = lambda n: F.col(f"r.current.{n}")
    first = lambda n: F.get(F.col(f"r.daily.{n}"), 0)
    rain = F.coalesce(first("rain_sum"), F.lit(0.0))
    chance = first("precipitation_probability_max")
    code = F.coalesce(now("weather_code"), F.lit(-1))
    current = {
        "temperature_c": now("temperature_2m"),
        "feels_like_c": now("apparent_temperature"),
        "humidity_percent": now("relative_humidity_2m"),
        "precipitation_mm": now("precipitation"),
        "rain_mm": now("rain"),
        "wind_speed_kmh": now("wind_speed_10m"),
        "weather_code": code,
        "condition": _text(code),
    }
    today = {
        "max_temperature_c": first("temperature_2m_max"),
        "min_temperature_c": first("temperature_2m_min"),
        "precipitation_sum_mm": first("precipitation_sum"),
        "rain_sum_mm": rain,
        "precipitation_probability_percent": chance,
        "weather_code": first("weather_code"),
        "condition": _text(first("weather_code")),
        "will_rain": will_rain(rain, chance),
    }
    return rows.select(*keys, *_record("r.place", F.col("r.timezone"), first("time"), current, today))


def station_records(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Observation records from responses with numbers as texts."""
    rows = df.select(*keys, F.from_json(column, STATION).alias("r")).select(
        *keys, "r.place", F.get("r.current_condition", 0).alias("c"), F.get("r.weather", 0).alias("w")
    )
    number = lambda n: parse_number(F.col(n))
    rain, temp = number("c.precipMM"), number("c.temp_C")
    code = number("c.weatherCode").cast("int")
    text = F.coalesce(F.nullif(F.get("c.weatherDesc", 0)["value"], F.lit("")), F.lit("unknown"))
    current = {
        "temperature_c": temp,
        "feels_like_c": number("c.FeelsLikeC"),
        "humidity_percent": number("c.humidity"),
        "precipitation_mm": rain,
        "rain_mm": rain,
        "wind_speed_kmh": number("c.windspeedKmph"),
        "weather_code": code,
        "condition": text,
    }
    today = {
        "max_temperature_c": F.coalesce(number("w.maxtempC"), temp),
        "min_temperature_c": F.coalesce(number("w.mintempC"), temp),
        "precipitation_sum_mm": rain,
        "rain_sum_mm": rain,
        "precipitation_probability_percent": F.lit(None).cast("double"),
        "weather_code": code,
        "condition": text,
        "will_rain": will_rain(rain),
    }
    return rows.select(*keys, *_record("place", F.lit(None).cast("string"), F.col("w.date"), current, today))


def normalized_record(raw: Column) -> Column:
    """One nested record from a JSON text whose fields may go by several names."""
    value = lambda *paths: F.coalesce(
        *[F.get_json_object(raw, f"$.{p}").try_cast("double") for p in paths]
    )
    text = lambda *paths: F.coalesce(*[F.get_json_object(raw, f"$.{p}") for p in paths])
    condition = F.get_json_object(raw, "$.current.condition")
    plain_condition = F.when(~condition.startswith("{"), condition)
    return F.struct(
        F.struct(*[text(f"location.{n}").alias(n) for n in ("name", "admin1", "country")]).alias("location"),
        F.struct(
            value("current.temperature_c", "current.temp_c", "current.temperature").alias("temperature_c"),
            value("current.feels_like_c", "current.feelslike_c").alias("feels_like_c"),
            value("current.humidity_percent", "current.humidity").alias("humidity_percent"),
            value("current.wind_speed_kmh", "current.wind_kph").alias("wind_speed_kmh"),
            F.coalesce(text("current.condition.text"), plain_condition).alias("condition"),
        ).alias("current"),
        F.struct(
            value("today.min_temperature_c", "today.mintemp_c").alias("min_temperature_c"),
            value("today.max_temperature_c", "today.maxtemp_c").alias("max_temperature_c"),
            value("today.rain_sum_mm", "today.totalprecip_mm").alias("rain_sum_mm"),
        ).alias("today"),
    )
