"""Classifying questions: all functions map a text column to a column.

Keywords are substrings of the lower-cased text unless ``whole_words`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.text import YEAR, has_any, normalize, parse_texts

# Keyword lists of the classifiers.
INTENT_WEATHER = [
    "weather", "today", "now", "live", "forecast", "rain", "humidity", "wind",
    "temperature", "temp",
]
INTENT_CLIMATE = [
    "climate", "trend", "warming", "historical", "history", "average", "change",
    "dataset", "csv", "warmest", "volatility",
]

TYPE_WORDS = {
    "meta": [
        "how many columns", "how many countries", "how many regions", "how many years",
        "what columns", "date range", "what is in", "describe the dataset", "dataset summary",
        "schema", "what data", "what fields", "list columns", "list countries", "list regions",
        "all countries", "all regions", "total countries", "total regions", "column names",
        "field names", "what are the columns", "which columns", "show columns",
        "how many records", "how many data points", "what years", "years covered",
        "year range", "what countries are", "countries in the dataset", "countries included",
        "regions in the dataset", "list all", "show all", "all the countries",
        "all the regions", "complete list", "full list", "show me the columns",
        "how many entries", "how many rows",
    ],
    "summary": [
        "summarize", "summary", "tell me about", "overview of", "profile of", "give me info",
        "what do you know about", "information about", "insights about", "analysis of",
        "describe", "explain", "break down",
    ],
    "stat": [
        "mean", "median", "average", "std", "standard deviation", "variance", "minimum",
        "maximum", "range", "percentile", "distribution", "statistics", "stats", "deviation",
    ],
    "rank": [
        "top", "bottom", "rank", "ranking", "hottest", "coldest", "warmest", "coolest",
        "fastest", "slowest", "highest", "lowest", "most", "least",
    ],
    "compare": [
        "compare", "vs", "versus", "against", "difference between", "better than",
        "worse than", "both",
    ],
    "trend": [
        "trend", "over time", "over years", "change", "warming", "cooling", "increase",
        "decrease", "grow", "rise", "fall", "historical", "history", "since", "from", "to",
    ],
    "filter": [
        "in europe", "in asia", "in africa", "in america", "in oceania", "in the region",
        "countries in", "regions in", "which countries", "which regions",
        "show me countries", "show me regions",
    ],
}

LATEST_YEAR_WORDS = ["this year", "latest year", "current year", "most recent year"]

WEATHER_LIKE = [
    "weather", "rain", "rainfall", "storm", "humidity", "forecast", "temperature", "temp",
    "hot", "cold", "wind", "climate", "sunny", "heat",
]
WEATHER_PAST = [
    "weather", "temperature", "temp", "rain", "hot", "cold", "climate", "humidity", "wind",
    "condition", "forecast", "warm", "cool", "rainfall", "storm",
]

FOLLOWUP_NEW_YEAR = ["this year", "latest year", "last year", "current year"]
FOLLOWUP_FRESH = [
    "top ", "how many", "list all", "all countries", "all regions", "compare", "vs ",
    "versus", "rank", "ranking", "hottest", "coldest", "warmest", "coolest", "highest",
    "lowest", "fastest", "slowest",
]
FOLLOWUP_WORDS = [
    "why", "reason", "what about", "tell me more", "elaborate", "continue", "details",
    "more info", "this region", "that region", "this country", "that country",
    "why is that", "what does that mean", "explain that", "explain it",
]

ROUTE_TABLE = [
    "csv", "dataset", "data", "record", "records", "column", "columns", "summary",
    "summarize", "country", "countries", "climate", "warming", "cooling", "coolest",
    "coldest", "trend", "trends", "historical", "history", "average", "median", "maximum",
    "minimum", "standard deviation", "deviation", "range", "outlier", "outliers", "rank",
    "ranking", "highest", "lowest", "increase", "decrease", "stable", "stability",
    "affected", "findings", "insights", "patterns", "volatility", "hottest", "fastest",
    "region", "regions", "country climate", "how many", "top",
]
ROUTE_LIVE = [
    "weather", "today", "now", "live", "current", "forecast", "rain", "humidity", "wind",
    "condition", "conditions", "feels like",
]
ROUTE_TEMPERATURE = ["temperature", "temp", "hot", "cold"]
ROUTE_HYBRID = ["weather and climate", "live and csv", "weather with csv"]
ROUTE_HYBRID_TABLE = ["csv", "dataset", "climate trend", "historical"]
ROUTE_TIME = [
    "this year", "latest year", "latest", "last year", "past", "yearly", "over years",
    "historical", "history",
]
ROUTE_PLACE_WEATHER = [
    "temperature", "temp", "weather", "hot", "cold", "rain", "humidity", "wind",
    "condition", "forecast",
]
ROUTE_LAST_CHANCE = [
    "climate", "temperature", "warming", "weather", "rain", "humidity", "forecast",
    "emission", "emissions", "region", "country", "trend", "trends", "dataset", "csv",
    "environment", "global warming",
]

TERM_STOP_WORDS = [
    "what", "is", "are", "the", "a", "an", "in", "of", "for", "to", "from", "using",
    "based", "on", "csv", "dataset", "data", "climate", "weather", "trend", "trends",
    "warming", "temperature", "average", "show", "tell", "me", "about", "compare", "with",
    "and", "today", "now", "live", "current", "how", "why", "explain", "region", "regions",
    "country", "countries", "year", "years", "change", "changed", "latest", "first", "last",
    "fastest", "hottest", "warmest", "top", "rank", "ranking", "emissions", "emission",
    "emitting", "emitted", "highest", "lowest", "most", "least", "best", "worst", "by",
    "per", "each", "all", "every", "any", "some", "coldest", "coolest", "slowest", "give",
    "list", "find", "get", "fetch",
]


def _lower(text: Column) -> Column:
    return F.lower(F.trim(text))


def intent(text: Column, whole_words: bool = False) -> Column:
    """climate / comparison / weather / unsupported; a year always means climate."""
    q = _lower(text)
    weather = has_any(q, INTENT_WEATHER, whole_words)
    climate = has_any(q, INTENT_CLIMATE, whole_words)
    return (
        F.when(q.isNull() | (q == ""), "unsupported")
        .when(q.rlike(YEAR), "climate")
        .when(weather & climate & q.contains("compare"), "comparison")
        .when(climate, "climate")
        .when(weather, "weather")
        .otherwise("unsupported")
    )


def question_type(text: Column, whole_words: bool = False) -> Column:
    """First hit of meta, summary, stat, rank, compare, trend, filter; else general."""
    q = F.lower(text)
    result = F
    for name, keywords in TYPE_WORDS.items():
        result = result.when(has_any(q, keywords, whole_words), name)
    return result.otherwise("general")


def top_n(text: Column, default: int = 10, cap: int = 200) -> Column:
    """The number of rows a question asks for, by the first of four patterns that hits."""
    q = F.when(text.rlike("[0-9]"), F.lower(text))  # all patterns hold a digit
    # The ways a number of rows is asked for.
    entity = "countries|regions|hottest|coolest|warmest|fastest|coldest|slowest"
    patterns = [
        r"(?U)\btop[\s\-_]?([0-9]+)\b",
        rf"(?U)\b([0-9]+)\s+(?:{entity})\b",
        r"(?U)\b(?:show|give|list|find|get|fetch|display)\s+(?:me\s+)?([0-9]+)\b",
        r"(?U)\b([0-9]+)\b.*?\b(?:countries|regions|results|entries|rows|records)\b",
    ]
    # No match is an empty text, and that is no number.
    number = [F.regexp_extract(q, p, 1).try_cast("double") for p in patterns]
    return F.least(F.coalesce(*number, F.lit(float(default))), F.lit(float(cap))).cast("int")


def requested_year(text: Column, latest: Column) -> Column:
    """A year in the text, or ``latest`` if the text asks for the latest year."""
    q = F.lower(text)
    explicit = F.regexp_extract(q, YEAR, 1).try_cast("int")
    return F.coalesce(explicit, F.when(has_any(q, LATEST_YEAR_WORDS), latest))


def looks_like_weather(q: Column) -> Column:
    """Weather word or a place preposition."""
    return has_any(q, WEATHER_LIKE + [" in ", " at ", " of "])


def asks_past_weather(q: Column, date: Column) -> Column:
    """A past date together with a weather word."""
    return date.isNotNull() & has_any(q, WEATHER_PAST)


def is_followup(q: Column, place: Column) -> Column:
    """Refers back, and names no new year, place or ranking."""
    # The pattern of past years is a fixed value.
    fresh = has_any(q, FOLLOWUP_NEW_YEAR) | place.isNotNull() | q.rlike(YEAR)
    return (
        F.when(fresh, False)
        .when(q.rlike(r"(?U)\b(last|past|previous)\s+[0-9]+\s+years?\b"), True)
        .when(has_any(q, FOLLOWUP_FRESH), False)
        .otherwise(has_any(q, FOLLOWUP_WORDS))
    )


def fixed_route(q: Column, place: Column, date: Column) -> Column:
    """The route a place, date or time word settles on its own; else null."""
    has_place = place.isNotNull()
    place_weather = has_place & has_any(q, ROUTE_PLACE_WEATHER)
    has_year = q.rlike(YEAR)
    past = has_place & date.isNotNull() & has_any(q, WEATHER_PAST)
    return F.when(past | (place_weather & has_year), "historical_weather").when(
        has_any(q, ROUTE_TIME) | (has_year & ~place_weather), "climate"
    )


def early_route(q: Column) -> Column:
    """What keywords settle before a known place is looked for; else null."""
    table, live = has_any(q, ROUTE_TABLE), has_any(q, ROUTE_LIVE)
    hybrid = has_any(q, ROUTE_HYBRID) | (live & has_any(q, ROUTE_HYBRID_TABLE))
    return F.when(hybrid, "hybrid").when(live & ~table, "weather").when(table, "climate")


def late_route(q: Column, place: Column) -> Column:
    """What keywords settle for a text that names no known place."""
    warm_place = has_any(q, ROUTE_TEMPERATURE) & place.isNotNull()
    return F.when(has_any(q, ROUTE_LIVE) | warm_place, "weather").when(has_any(q, ROUTE_LAST_CHANCE), "climate").otherwise("out_of_scope")


def keyword_route(early: Column, names_place: Column, late: Column) -> Column:
    """The two parts with, between them, whether the text names a known place."""
    return F.coalesce(early, F.when(names_place, "climate"), late)


def source_of(route: Column) -> Column:
    """What a route leaves behind as the last answer source; null if it leaves the state alone."""
    return F.when(route == "historical_weather", "weather").when(route != "out_of_scope", route)


def followup_route(last_source: Column) -> Column:
    """The route a follow-up takes over; a mixed answer carries on as climate."""
    return F.when(last_source == "hybrid", "climate").otherwise(last_source)


def with_routes(df: DataFrame, text: str, as_of: Column) -> DataFrame:
    """Add ``q, place, date, fixed, follow, early, late``; and ``keyword`` to texts that have ``names_place``."""
    q, place, date = F.col("q"), F.col("place"), F.col("date")
    routed = parse_texts(df, text, as_of).withColumns(
        {"fixed": fixed_route(q, place, date), "follow": is_followup(q, place), "early": early_route(q)}
    )
    routed = routed.withColumn("late", F.when(F.col("early").isNull(), late_route(q, place)))
    if "names_place" not in df.columns:
        return routed
    return routed.withColumn("keyword", keyword_route(F.col("early"), F.col("names_place"), F.col("late")))


def answer_route(last_source: Column) -> Column:
    """historical_weather / climate / weather / hybrid / out_of_scope of a row of ``with_routes``."""
    carried = F.when(F.col("follow"), followup_route(last_source))
    return F.coalesce("fixed", carried, "keyword")


def search_terms(text: Column) -> Column:
    """Distinct words longer than two letters that are no stop word."""
    tokens = F.split(normalize(text), " ")
    return F.array_distinct(
        F.filter(tokens, lambda w: (F.length(w) > 2) & ~w.isin(TERM_STOP_WORDS))
    )
