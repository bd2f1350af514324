"""Fixed lookup values. Their sizes never grow with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The region each known country belongs to.
COUNTRIES_OF_REGION = {
    "North America": [
        "Mexico", "United States", "Canada", "Guatemala", "Cuba", "Haiti",
        "Dominican Republic", "Honduras", "Nicaragua", "Costa Rica", "Panama",
        "El Salvador", "Belize", "Jamaica", "Trinidad and Tobago",
    ],
    "South America": [
        "Brazil", "Argentina", "Colombia", "Peru", "Venezuela", "Chile", "Ecuador",
        "Bolivia", "Paraguay", "Uruguay", "Guyana", "Suriname",
    ],
    "Europe": [
        "Germany", "France", "United Kingdom", "Italy", "Spain", "Poland",
        "Netherlands", "Belgium", "Sweden", "Norway", "Denmark", "Finland",
        "Switzerland", "Austria", "Portugal", "Czech Republic", "Romania", "Hungary",
        "Greece", "Ukraine", "Russia",
    ],
    "Asia": [
        "China", "India", "Japan", "South Korea", "Indonesia", "Vietnam", "Thailand",
        "Malaysia", "Philippines", "Pakistan", "Bangladesh", "Myanmar", "Nepal",
        "Sri Lanka", "Cambodia",
    ],
    "Africa": [
        "Nigeria", "Ethiopia", "South Africa", "Kenya", "Ghana", "Tanzania", "Egypt",
        "Morocco", "Algeria", "Sudan", "Uganda", "Mozambique", "Madagascar", "Angola",
        "Cameroon",
    ],
    "Oceania": ["Australia", "New Zealand", "Papua New Guinea", "Fiji"],
    "Middle East": [
        "Saudi Arabia", "Iran", "Iraq", "Israel", "Jordan", "Kuwait",
        "United Arab Emirates", "Qatar", "Bahrain", "Oman", "Syria", "Lebanon", "Yemen",
    ],
}

# Weather code texts.
WEATHER_CODES = {
    0: "clear sky", 1: "mainly clear", 2: "partly cloudy", 3: "overcast",
    45: "fog", 48: "depositing rime fog",
    51: "light drizzle", 53: "moderate drizzle", 55: "dense drizzle",
    61: "slight rain", 63: "moderate rain", 65: "heavy rain",
    80: "slight rain showers", 81: "moderate rain showers", 82: "violent rain showers",
    95: "thunderstorm", 96: "thunderstorm with slight hail", 99: "thunderstorm with heavy hail",
}

# Month names and their short forms.
MONTHS = {
    "january": "01", "february": "02", "march": "03", "april": "04", "may": "05",
    "june": "06", "july": "07", "august": "08", "september": "09", "october": "10",
    "november": "11", "december": "12",
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "jun": "06", "jul": "07",
    "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}

# Other names of countries, one list per use.
COMPARE_ALIASES = {
    "usa": "united states", "us": "united states", "america": "united states",
    "uk": "united kingdom", "britain": "united kingdom", "uae": "united arab emirates",
}
FACT_ALIASES = {
    "usa": "united states", "us": "united states", "u s": "united states",
    "america": "united states", "uk": "united kingdom", "britain": "united kingdom",
}
STATION_ALIASES = {
    "usa": "united states", "us": "united states", "america": "united states",
    "uk": "united kingdom", "britain": "united kingdom", "england": "united kingdom",
    "uae": "united arab emirates", "south korea": "korea", "north korea": "korea",
    "russian federation": "russia", "people s republic of china": "china",
    "czech republic": "czechia", "viet nam": "vietnam",
}
PLACE_ALIASES = {"nyc": "New York", "usa": "United States", "uk": "United Kingdom"}
COUNTRY_OF_CITY = {
    "chennai": "india", "mumbai": "india", "delhi": "india", "bangalore": "india",
    "kolkata": "india", "tokyo": "japan", "london": "united kingdom", "paris": "france",
    "new york": "united states", "sydney": "australia",
}

REGION_OF_COUNTRY = {c: r for r, names in COUNTRIES_OF_REGION.items() for c in names}


def lookup_table(spark: SparkSession, values: dict, schema: str) -> DataFrame:
    """A fixed mapping as a two-column table; the caller may broadcast it."""
    return spark.createDataFrame(list(values.items()), schema)


def map_column(values: dict, key: Column) -> Column:
    """A fixed mapping as a literal map, looked up by ``key``; null where unknown."""
    parts = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*parts), key)
