"""Rows as sentences and key-value facts.

The wording of the sentences and labels is a fixed value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.numbers import fmt_number

# The columns of a fact line, in order.
FACT_KEYS = [
    "Country", "Region", "LatestTemperature", "HottestYear", "HottestTemperature",
    "AverageTemperature", "TemperatureChange", "WarmingTrendPerYear", "VolatilityScore",
    "FirstRegionalTemperature", "LatestRegionalTemperature", "RegionalTemperatureChange",
    "RegionalAverageTemperature", "RegionalWarmingTrendPerYear", "RegionalVolatilityScore",
    "Year", "AvgTemperature", "TempChange", "TotalTempChange",
]


def sentence(*parts) -> Column:
    """The parts in one text, or null if any of them is missing."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def degrees(name: str) -> Column:
    return fmt_number(F.col(name), " C", 2)


def per_year(name: str) -> Column:
    return fmt_number(F.col(name), " C/year", 4)


def fact_line(df: DataFrame) -> Column:
    """``key: value; ...`` over the known columns that exist and are not null."""
    facts = []
    for key in FACT_KEYS:
        if key in df.columns:
            value = F.col(key).cast("string")
            if dict(df.dtypes)[key] in ("float", "double"):
                value = F.when(~F.isnan(key), value)
            facts.append(sentence(f"{key}: ", value))
    return F.concat_ws("; ", *facts)


def country_summary() -> Column:
    """What a country trend row says."""
    opener = F.concat(
        F.lit("For "), F.col("Country"), F.coalesce(F.concat(F.lit(" in "), F.col("Region")), F.lit(""))
    )
    change = degrees("TemperatureChange")
    return F.concat_ws(
        " ",
        sentence(opener, ", the latest temperature in the CSV is ", degrees("LatestTemperature"), "."),
        F.coalesce(
            sentence("The dataset shows a total warming of ", change, ", with a trend of ", per_year("WarmingTrendPerYear"), "."),
            sentence("The dataset shows a total warming of ", change, "."),
        ),
        sentence("Its average temperature across the dataset period is ", degrees("AverageTemperature"), "."),
        sentence("The hottest recorded year is ", F.col("HottestYear").cast("string"), ", at ", degrees("HottestTemperature"), "."),
        sentence("The volatility score is ", fmt_number(F.col("VolatilityScore"), "", 3), "."),
    )


def yearly_summary() -> Column:
    """What a yearly row says."""
    label = F.concat(F.col("Country"), F.coalesce(F.concat(F.lit(" in "), F.col("Region")), F.lit("")))
    return F.concat_ws(
        " ",
        F.coalesce(
            sentence("For ", label, ", the CSV yearly temperature for ", F.col("Year").cast("string"), " is ", degrees("AvgTemperature"), "."),
            sentence("For ", label, ", the matching CSV yearly temperature is ", degrees("AvgTemperature"), "."),
        ),
        sentence("The year-to-year temperature change is ", degrees("TempChange"), "."),
        sentence("The total change from the dataset baseline is ", degrees("TotalTempChange"), "."),
        sentence("The matching regional average temperature is ", degrees("RegionalAverageTemperature"), "."),
    )


def regional_summary() -> Column:
    """What a regional trend row says."""
    change = degrees("RegionalTemperatureChange")
    return F.concat_ws(
        " ",
        sentence("At the regional level, ", F.col("Region"), " rose from ", degrees("FirstRegionalTemperature"),
                 " to ", degrees("LatestRegionalTemperature"), "."),
        F.coalesce(
            sentence("That is a regional change of ", change, ", with a trend of ", per_year("RegionalWarmingTrendPerYear"), "."),
            sentence("That is a regional change of ", change, "."),
        ),
        sentence("The regional volatility score is ", fmt_number(F.col("RegionalVolatilityScore"), "", 3), "."),
    )


def country_against_region() -> Column:
    """A country trend row next to the row of its region; empty if neither has a change."""
    own, region = degrees("TemperatureChange"), degrees("RegionalTemperatureChange")
    missing = F.lit("N/A")
    return F.coalesce(
        sentence(
            "Compared with ", F.col("Region"), ", ", F.col("Country"), "'s total warming is ", own,
            ", while the regional change is ", region, ". Per-year trends: ",
            F.coalesce(per_year("WarmingTrendPerYear"), missing), " for ", F.col("Country"), ", ",
            F.coalesce(per_year("RegionalWarmingTrendPerYear"), missing), " for ", F.col("Region"), ".",
        ),
        F.when(
            own.isNotNull() | region.isNotNull(),
            sentence("Country-level change: ", F.coalesce(own, missing), ", regional change: ", F.coalesce(region, missing), "."),
        ),
        F.lit(""),
    )


def _reader(record: str, decimals: int | None):
    """Texts of the fields of an observation record; numbers as they are, or rounded to ``decimals``."""

    def text(path: str, nothing: str = "N/A") -> Column:
        c = F.col(f"{record}.{path}")
        shown = c.cast("string") if decimals is None or path.endswith("condition") else F.when(c.isNotNull(), fmt_number(c, "", decimals))
        return F.coalesce(shown, F.lit(nothing))

    place = F.concat_ws(", ", *[F.nullif(F.col(f"{record}.location.{n}"), F.lit("")) for n in ("name", "admin1", "country")])
    return text, place


def weather_lines(record: str, date: Column | None = None, decimals: int | None = None) -> Column:
    """An observation record as label-value lines."""
    text, place = _reader(record, decimals)
    return F.concat(
        F.lit("Location: "), F.coalesce(F.nullif(place, F.lit("")), F.lit("Unknown")),
        F.lit("\nDate: "), F.coalesce(date, F.lit("Unknown")) if date is not None else F.lit("Unknown"),
        F.lit("\nTemperature: "), text("current.temperature_c"), F.lit(" C"),
        F.lit("\nFeels Like: "), text("current.feels_like_c"), F.lit(" C"),
        F.lit("\nCondition: "), text("current.condition", "Unknown"),
        F.lit("\nHumidity: "), text("current.humidity_percent"), F.lit("%"),
        F.lit("\nWind Speed: "), text("current.wind_speed_kmh"), F.lit(" km/h"),
        F.lit("\nToday Min: "), text("today.min_temperature_c"), F.lit(" C"),
        F.lit("\nToday Max: "), text("today.max_temperature_c"), F.lit(" C"),
        F.lit("\nRain: "), text("today.rain_sum_mm"), F.lit(" mm"),
    )


def weather_answer(record: str, decimals: int | None = None) -> Column:
    """An observation record as an answer with a forecast part."""
    text, place = _reader(record, decimals)
    return F.concat(
        F.lit("Weather Analysis\n\nLocation: "), place,
        F.lit("\nTemperature: "), text("current.temperature_c"), F.lit("°C\nFeels like: "), text("current.feels_like_c"),
        F.lit("°C\nCondition: "), text("current.condition"), F.lit("\nHumidity: "), text("current.humidity_percent"),
        F.lit("%\nWind: "), text("current.wind_speed_kmh"), F.lit(" km/h\n\nForecast:\nMin: "), text("today.min_temperature_c"),
        F.lit("°C\nMax: "), text("today.max_temperature_c"), F.lit("°C\nRain: "), text("today.rain_sum_mm"), F.lit(" mm\n"),
    )


def weather_context(record: str, date: Column, historical: Column, decimals: int | None = None) -> Column:
    """An observation record as context; a historical one has no felt temperature and no humidity, and names its date."""
    read, _ = _reader(record, decimals)
    text = lambda path: read(path, "None")
    place = lambda n: F.coalesce(F.col(f"{record}.location.{n}"), F.lit("None"))
    current = lambda label, path, unit: F.when(historical, "").otherwise(F.concat(F.lit(label), text(path), F.lit(unit)))
    title = F.when(historical, F.concat(F.lit("Historical weather on "), F.coalesce(date, F.lit("")))).otherwise("Current conditions")
    return F.concat(
        F.lit("\nLocation: "), place("name"), F.lit(", "), place("country"), F.lit("\n"), title,
        F.lit("\n\nTemperature: "), text("current.temperature_c"), F.lit("°C\n"),
        current("Feels Like: ", "current.feels_like_c", "°C"), F.lit("\nCondition: "), text("current.condition"), F.lit("\n"),
        current("Humidity: ", "current.humidity_percent", "%"), F.lit("\nWind Speed: "), text("current.wind_speed_kmh"),
        F.lit(" km/h\n\nDaily Summary:\nMin Temp: "), text("today.min_temperature_c"), F.lit("°C\nMax Temp: "),
        text("today.max_temperature_c"), F.lit("°C\nRain: "), text("today.rain_sum_mm"), F.lit(" mm\n"),
    )
