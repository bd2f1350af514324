"""Fixed schemas of the tables."""

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*groups: tuple[T.DataType, str]) -> T.StructType:
    """Fields from (type, names) pairs, names separated by blanks."""
    return T.StructType([T.StructField(name, dtype) for dtype, names in groups for name in names.split()])


RAW_PANEL = _struct((S, "Country Region Year AvgTemperature"))

PANEL = _struct((S, "Country Region"), (I, "Year"), (D, "AvgTemperature"))

YEARLY = _struct(
    (S, "Country Region"),
    (I, "Year"),
    (D, "AvgTemperature TempChange BaselineTemperature TotalTempChange"),
    (D, "RegionalAverageTemperature RegionalTempChange"),
)

COUNTRY_TRENDS = _struct(
    (S, "Region Country"),
    (I, "FirstYear LatestYear"),
    (D, "FirstTemperature LatestTemperature AverageTemperature TemperatureChange"),
    (D, "WarmingTrendPerYear VolatilityScore"),
    (I, "HottestYear"),
    (D, "HottestTemperature"),
)

REGIONAL_TRENDS = _struct(
    (S, "Region"),
    (I, "FirstYear LatestYear"),
    (D, "FirstRegionalTemperature LatestRegionalTemperature AverageRegionalTemperature"),
    (D, "RegionalTemperatureChange RegionalWarmingTrendPerYear RegionalVolatilityScore"),
)

PLACE = _struct((S, "name country admin1"), (D, "latitude longitude"))

# One archive response: parallel arrays per metric, elements may be null.
ARCHIVE = _struct(
    (PLACE, "location"),
    (
        _struct(
            (T.ArrayType(S), "time"),
            (T.ArrayType(D), "temperature_2m_max temperature_2m_min temperature_2m_mean"),
            (T.ArrayType(D), "precipitation_sum rain_sum wind_speed_10m_max"),
            (T.ArrayType(I), "weather_code"),
        ),
        "daily",
    ),
)

# First observation shape: numbers, daily values as one-element arrays.
FORECAST = _struct(
    (PLACE, "place"),
    (S, "timezone"),
    (
        _struct(
            (D, "temperature_2m relative_humidity_2m apparent_temperature precipitation rain"),
            (I, "weather_code"),
            (D, "wind_speed_10m"),
        ),
        "current",
    ),
    (
        _struct(
            (T.ArrayType(S), "time"),
            (T.ArrayType(D), "temperature_2m_max temperature_2m_min precipitation_sum rain_sum"),
            (T.ArrayType(D), "precipitation_probability_max"),
            (T.ArrayType(I), "weather_code"),
        ),
        "daily",
    ),
)

# Second observation shape: numbers as strings under other names.
STATION = _struct(
    (PLACE, "place"),
    (
        T.ArrayType(
            _struct(
                (S, "temp_C FeelsLikeC humidity windspeedKmph precipMM weatherCode"),
                (T.ArrayType(_struct((S, "value"))), "weatherDesc"),
            )
        ),
        "current_condition",
    ),
    (T.ArrayType(_struct((S, "date mintempC maxtempC"))), "weather"),
)

DATASET_TABLES = {
    "raw": RAW_PANEL,
    "main": YEARLY,
    "country_trends": COUNTRY_TRENDS,
    "regional_trends": REGIONAL_TRENDS,
    "fastest_regions": REGIONAL_TRENDS,
    "hottest_countries": COUNTRY_TRENDS,
}
