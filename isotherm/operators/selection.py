"""Filters, semi joins and place-wise row selection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.numbers import display_value
from isotherm.functions.questions import requested_year
from isotherm.functions.text import has_any

# Words of a question that select no rows, and words that ask for all rows.
RELEVANT_STOP_WORDS = {
    "what", "is", "the", "a", "an", "of", "in", "on", "and", "to", "for", "why", "how",
    "tell", "me",
}
RELEVANT_ALL_ROWS = [
    "top", "highest", "lowest", "hottest", "coldest", "rank", "ranking", "trend", "compare",
]
KNOWN_CATEGORIES = ["Country", "country", "Region", "region", "State", "state"]
KNOWN_MEASURES = ["AvgTemperature", "avgtemperature", "cases", "Cases", "value", "Value"]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def project_existing(df: DataFrame, columns, max_rows: int | None = None, order=()) -> DataFrame:
    """Those of ``columns`` that exist; as a preview the first ``max_rows`` in ``order``, ties by all columns."""
    head = df if max_rows is None else df.orderBy(*order, *df.columns).limit(max_rows)
    return head.select([c for c in columns if c in df.columns])


def pick_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """Category and measure column: known names first, else the first text / number."""
    kinds = dict(df.dtypes)
    texts = [c for c, t in kinds.items() if t == "string"]
    numbers = [c for c, t in kinds.items() if is_numeric(t)]
    category = next((c for c in df.columns if c in KNOWN_CATEGORIES), texts[0] if texts else None)
    measure = next((c for c in df.columns if c in KNOWN_MEASURES), numbers[0] if numbers else None)
    return category, measure


def filter_region(df: DataFrame, region: str) -> DataFrame:
    return df.where(F.lower("Region") == region.strip().lower())


def filter_year(df: DataFrame, year: int) -> DataFrame:
    """Rows of ``year``; all rows if there are none."""
    hit = F.col("Year") == year
    found = df.select(F.max(hit)).scalar()
    return df.where(hit | ~F.coalesce(found, F.lit(False)))


def latest_year_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("Year") == df.select(F.max("Year")).scalar())


def cooling(trends: DataFrame) -> DataFrame:
    return trends.where("TemperatureChange < 0")


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any cell, as shown in a table, contains ``text``, ignoring case."""
    needle = text.strip().lower()
    if not needle:
        return df
    cells = [F.lower(display_value(F.col(c), t)).contains(needle) for c, t in df.dtypes]
    return df.where(reduce(lambda a, b: a | b, cells))


def relevant_rows(df: DataFrame, question: str, max_rows: int | None = None) -> DataFrame:
    """Rows that contain any word of the question; all rows if none does; of these the first ``max_rows`` by all columns."""
    q = question.lower()
    if any(w in q for w in RELEVANT_ALL_ROWS):
        return df
    words = [w for w in dict.fromkeys(re.findall("[a-z]+", q)) if w not in RELEVANT_STOP_WORDS]
    if not words:
        return df
    row_text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    hit = reduce(lambda a, b: a | b, [row_text.contains(w) for w in words])
    found = F.coalesce(df.select(F.max(hit)).scalar(), F.lit(False))
    kept = df.where(hit | ~found)
    return kept if max_rows is None else kept.orderBy(*df.columns).limit(max_rows)


def rows_of_year(questions: DataFrame, key: str, text: str, yearly: DataFrame) -> DataFrame:
    """Per question: the year it asks for and how many rows and what mean that year has.

    One row per distinct year is joined, not the yearly rows themselves.
    """
    from isotherm.operators.profile import global_by_year

    latest = yearly.select(F.max("Year")).scalar()
    asked = questions.select(key, requested_year(F.col(text), F.lit(-1)).alias("Year")).where(
        "Year IS NOT NULL"
    )
    asked = asked.withColumn("Year", F.when(F.col("Year") == -1, latest).otherwise(F.col("Year")))
    return asked.join(global_by_year(yearly), "Year", "left").select(
        key, "Year", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "GlobalAverage"
    )


def countries_of_regions(trends: DataFrame, regions: DataFrame, n: int = 10) -> DataFrame:
    """Countries of the given regions, largest change first."""
    hit = trends.join(regions.select("Region"), "Region", "left_semi")
    return hit.orderBy(F.desc("TemperatureChange"), "Region", "Country").limit(n).select(*trends.columns)


def regions_of_countries(regional: DataFrame, countries: DataFrame, n: int = 10) -> DataFrame:
    """Regional rows of the regions the given countries lie in."""
    hit = regional.join(countries.select("Region"), "Region", "left_semi")
    return hit.orderBy("Region").limit(n).select(*regional.columns)


def question_targets_region(questions: DataFrame, key: str, text: str, region_mentions: DataFrame) -> DataFrame:
    """``key, targets_region``: says region, or names one."""
    named = region_mentions.select(key).distinct().withColumn("_named", F.lit(True))
    says = has_any(F.lower(F.col(text)), ["region"])
    return questions.join(named, key, "left").select(
        key, (says | F.coalesce("_named", F.lit(False))).alias("targets_region")
    )


def place_names(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct names over several (table, column) pairs."""
    parts = [df.select(F.col(c).alias("name")).where("name IS NOT NULL").distinct() for df, c in tables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
