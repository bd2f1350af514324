"""Sorts, top-k tables, pages and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.functions.distributed import number_rows
from isotherm.functions.questions import top_n
from isotherm.functions.text import has_any

# Words that set the direction and the metric of a ranking.
ASCENDING_WORDS = ["coolest", "coldest", "lowest", "slowest", "least", "bottom"]
DESCENDING_WORDS = ["hottest", "warmest", "highest", "fastest", "most", "top"]
CHANGE_WORDS = ["warming", "warm", "fastest", "change", "trend"]
REGION_WORDS = ["region", "regional", "continent"]


def sort_numeric(df: DataFrame, column: str, ascending: bool = False, ties=(), name: str | None = None) -> DataFrame:
    """Sort by a column read as a number; rows without a number go; ``name`` adds the place of each row."""
    key = F.col(column)
    if dict(df.dtypes)[column] == "string":
        key = key.try_cast("double")
    keyed = df.withColumn("_sort", key).where("_sort IS NOT NULL AND NOT isnan(_sort)")
    order = F.asc("_sort") if ascending else F.desc("_sort")
    if name:
        return number_rows(keyed, order, *[F.asc(t) for t in ties], name=name).drop("_sort")
    return keyed.orderBy(order, *ties).drop("_sort")


def top_k(df: DataFrame, column: str, k: int, ascending: bool = False, ties=()) -> DataFrame:
    return sort_numeric(df, column, ascending, ties).limit(k)


def ranked(df: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank; the window sees only those ``k`` rows."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(W.orderBy(*order)))


def with_share(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Absolute value as percent of the largest absolute value, at most 100."""
    size = F.abs(F.col(column).cast("double"))
    largest = df.select(F.max(size)).scalar()
    scaled = df.withColumn("_max", largest)
    whole = F.when(F.coalesce("_max", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_max"))
    return scaled.withColumn(name, F.least(F.lit(100.0), size / whole * 100)).drop("_max")


def top_by_magnitude(df: DataFrame, label: str, column: str, k: int = 10) -> DataFrame:
    """The ``k`` largest absolute values with their share of the largest."""
    order = [F.desc(F.abs("value")), F.asc("label")]
    entries = df.select(
        F.col(label).cast("string").alias("label"), F.col(column).cast("double").alias("value")
    ).where("label <> '' AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
    head = ranked(entries, order, k)
    largest = F.first(F.abs("value")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    whole = F.when(largest == 0, 1.0).otherwise(largest)
    return head.withColumn("share", F.abs("value") / whole * 100)


def page(df: DataFrame, order: list[Column], number: int, size: int = 25, name: str | None = None) -> DataFrame:
    """Page ``number`` of a sorted table, clamped to the pages there are; ``name`` adds the row numbers.

    ``order`` must be total. Every page is cut in the same way from the distributed row numbers.
    """
    row, total = name or "_row", "_total"
    numbered = number_rows(df, *order, name=row, total=total)
    pages = F.greatest(F.ceil(F.col(total) / size), F.lit(1))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), pages)
    inside = F.col(row).between((at - 1) * size + 1, at * size)
    cut = numbered.where(inside).orderBy(row).drop(total)
    return cut if name else cut.drop(row)


def latest_rows(yearly: DataFrame, n: int = 5) -> DataFrame:
    """The latest ``n`` rows per country; trimmed per task before the shuffle."""
    by_year = W.partitionBy("Country").orderBy(F.desc("Year"), F.asc("Region"))
    return yearly.withColumn("_n", F.row_number().over(by_year)).where(F.col("_n") <= n).drop("_n")


def directional_ranking(
    countries: DataFrame, regions: DataFrame, by_change: bool, ascending: bool, n: int,
    regions_only: bool = False,
) -> DataFrame:
    """Country and region rankings as ``section, rank, entity, metric, value``."""
    parts = []
    order = lambda: [F.asc("value") if ascending else F.desc("value"), F.asc("entity"), F.asc("group")]
    if not regions_only:
        metric = "TemperatureChange" if by_change else "AverageTemperature"
        parts.append(("countries", countries, "Country", "Region", metric))
    metric = "RegionalTemperatureChange" if by_change else "AverageRegionalTemperature"
    parts.append(("regions", regions, "Region", "Region", metric))
    out = None
    for section, df, entity, group, metric in parts:
        rows = df.select(
            F.col(entity).alias("entity"), F.col(group).alias("group"), F.col(metric).alias("value")
        ).where("value IS NOT NULL AND NOT isnan(value)")
        part = ranked(rows, order(), n).select(
            F.lit(section).alias("section"), "rank", "entity", F.lit(metric).alias("metric"), "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


def ranking_request(text: Column) -> Column:
    """Struct ``ascending, by_change, neutral, regions_only`` read from a question."""
    q = F.lower(text)
    says = lambda words: F.coalesce(has_any(q, words), F.lit(False))
    low, high, by_change = says(ASCENDING_WORDS), says(DESCENDING_WORDS), says(CHANGE_WORDS)
    return F.struct(
        F.when(by_change, low & ~high).otherwise(low).alias("ascending"),
        by_change.alias("by_change"),
        (~low & ~high).alias("neutral"),
        says(REGION_WORDS).alias("regions_only"),
    )


def answer_rankings(
    questions: DataFrame, key: str, text: str, countries: DataFrame, regions: DataFrame, most: int = 200
) -> DataFrame:
    """The ranking each question asks for: join on (metric, direction) to ranked rows.

    A question that names no direction gets the coolest countries as well. ``most`` is the one limit: no question
    gets more rows than that, and each of the ten ranked lists, which are broadcast, has at most that many.
    """
    lists = None
    for by_change in (True, False):
        for ascending in (True, False):
            part = directional_ranking(countries, regions, by_change, ascending, most).select(
                F.lit(by_change).alias("by_change"), F.lit(ascending).alias("ascending"), "*"
            )
            lists = part if lists is None else lists.unionByName(part)
    coolest = directional_ranking(countries, regions, False, True, most).where("section = 'countries'")
    for by_change in (True, False):
        lists = lists.unionByName(
            coolest.withColumn("section", F.lit("coolest")).select(
                F.lit(by_change).alias("by_change"), F.lit(False).alias("ascending"), "*"
            )
        )
    wanted = (
        F.when(F.col("section") == "regions", True)
        .when(F.col("section") == "countries", ~F.col("regions_only"))
        .otherwise(F.col("neutral") & ~F.col("regions_only"))
    )
    asked = questions.select(
        key, ranking_request(F.col(text)).alias("_r"), F.coalesce(top_n(F.col(text), cap=most), F.lit(0)).alias("_n")
    ).select(key, "_r.*", "_n")
    return (
        asked.join(F.broadcast(lists), ["by_change", "ascending"])
        .where((F.col("rank") <= F.col("_n")) & wanted)
        .select(key, "section", "rank", "entity", "metric", "value")
    )
