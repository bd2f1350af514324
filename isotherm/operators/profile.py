"""Statistics, metadata and profiles of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.distributed import exact_median
from isotherm.functions.numbers import exact, mean, rint_to, round_to
from isotherm.operators.selection import is_numeric


def region_stats(yearly: DataFrame) -> DataFrame:
    """Mean per region, hottest first."""
    means = yearly.where("Region IS NOT NULL").groupBy("Region").agg(
        rint_to(mean(F.col("AvgTemperature")), 2).alias("AvgTemperature")
    )
    return means.orderBy(F.desc("AvgTemperature"), "Region")


def top_hottest(yearly: DataFrame, n: int = 10) -> DataFrame:
    """Countries with the highest mean."""
    means = yearly.where("Country IS NOT NULL").groupBy("Country").agg(
        rint_to(mean(F.col("AvgTemperature")), 2).alias("AvgTemperature")
    )
    return means.orderBy(F.desc("AvgTemperature"), "Country").limit(n)


def top_countries(trends: DataFrame, n: int = 10, sort_by: str = "TemperatureChange") -> DataFrame:
    """Mean change, highest latest value and mean slope per country; top ``n`` by one of them."""
    return (
        trends.dropna(subset=[sort_by, "Country"])
        .groupBy("Country")
        .agg(
            mean(exact(F.col("TemperatureChange"))).alias("TemperatureChange"),
            F.max("LatestTemperature").alias("LatestTemperature"),
            mean(exact(F.col("WarmingTrendPerYear"), 4)).alias("WarmingTrendPerYear"),
        )
        .orderBy(F.desc(sort_by), "Country")
        .limit(n)
    )


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: n, mean, median, min, max, std and range, to three decimals."""
    v = F.col(column)
    low, high = F.min(v).cast("double"), F.max(v).cast("double")
    row = df.where(v.isNotNull()).agg(
        F.count(v).alias("n"),
        mean(exact(v, 6)).alias("mean"),
        low.alias("min"),
        high.alias("max"),
        F.stddev_samp(v.cast("double")).alias("std"),
        (high - low).alias("range"),
    )
    # The median is a column before it is rounded: rounding reads its argument several times.
    whole = row.withColumn("median", exact_median(df, column).scalar())
    return whole.select("n", *[round_to(F.col(c), 3).alias(c) for c in ("mean", "min", "max", "std", "range", "median")])


def _by_place_and_year(df: DataFrame) -> DataFrame:
    """Rows per country, region and year: what distinct counts are taken from.

    Counting several distinct columns directly would multiply every row before
    the shuffle.
    """
    return df.groupBy("Country", "Region", "Year").agg(F.count("*").alias("_rows"))


def table_metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, distinct countries, regions and years, first and last year."""
    return _by_place_and_year(df).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.countDistinct("Country").alias("n_countries"),
        F.countDistinct("Region").alias("n_regions"),
        F.countDistinct("Year").alias("n_years"),
        F.min("Year").alias("first_year"),
        F.max("Year").alias("last_year"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """``value``: all distinct values as text, one per row; for any number of them."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    return values.distinct()


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """One row: number of distinct values, and all of them as one sorted array.

    One cell holds the whole list: the caller's choice, for columns of few names. ``distinct_values`` lists them as rows.
    """
    return distinct_values(df, column).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("names"))


def distinct_list(df: DataFrame, column: str) -> DataFrame:
    """All distinct values, sorted, as one text cell."""
    return distinct_names(df, column).withColumn("names", F.array_join("names", ", "))


def global_by_year(yearly: DataFrame) -> DataFrame:
    """Rows and mean over all countries per year."""
    return yearly.groupBy("Year").agg(
        F.count("*").alias("n_rows"), mean(exact(F.col("AvgTemperature"))).alias("GlobalAverage")
    )


def global_summary(yearly: DataFrame) -> DataFrame:
    """One row: first and latest global mean, change, hottest and coldest year."""
    v, year = F.col("GlobalAverage"), F.col("Year")
    first, latest = F.min_by(v, year), F.max_by(v, year)
    return global_by_year(yearly).where("GlobalAverage IS NOT NULL").agg(
        F.min(year).alias("first_year"),
        round_to(first, 3).alias("first_average"),
        F.max(year).alias("latest_year"),
        round_to(latest, 3).alias("latest_average"),
        round_to(latest - first, 3).alias("change"),
        F.max_by(year, F.struct(v, -year)).alias("hottest_year"),
        round_to(F.max(v), 3).alias("hottest_average"),
        F.min_by(year, F.struct(v, year)).alias("coldest_year"),
        round_to(F.min(v), 3).alias("coldest_average"),
    )


def last_periods(yearly: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` years of the global series, in order."""
    return global_by_year(yearly).orderBy(F.desc("Year")).limit(n).orderBy("Year").select(
        "Year", "GlobalAverage"
    )


def year_summary(yearly: DataFrame, year: int) -> DataFrame:
    """One row: how many rows a year has, and their mean."""
    return yearly.where(F.col("Year") == year).agg(
        F.lit(year).alias("Year"),
        F.count("*").alias("n_rows"),
        round_to(mean(exact(F.col("AvgTemperature"))), 3).alias("GlobalAverage"),
    )


def dashboard(yearly: DataFrame, trends: DataFrame, regional: DataFrame) -> DataFrame:
    """One row: rows, countries, regions and the region at the top of the trend table."""
    top = F.max_by(
        "Region", F.struct("RegionalTemperatureChange", "RegionalWarmingTrendPerYear")
    )
    fastest = regional.agg(top.alias("Region"))
    return yearly.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        trends.select(F.countDistinct(F.nullif("Country", F.lit("")))).scalar().alias("n_countries"),
        regional.select(F.countDistinct(F.nullif("Region", F.lit("")))).scalar().alias("n_regions"),
        fastest.select("Region").scalar().alias("fastest_region"),
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """``column, kind``: numeric by type, date if every value parses as one, else categorical.

    One aggregation over the text columns decides for all of them.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    fixed = {
        c: "numeric" if is_numeric(t) else "date" if t.startswith(("date", "timestamp")) else "categorical"
        for c, t in df.dtypes
        if t != "string"
    }
    checks = [
        F.when(F.count(c) == F.count(F.try_to_timestamp(F.col(c))), "date").otherwise("categorical").alias(c)
        for c in texts
    ]
    row = df.agg(*checks) if checks else df.limit(0).agg(F.lit(0).alias("_none"))
    kinds = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            (F.col(c) if c in texts else F.lit(fixed.get(c))).alias("kind"),
        )
        for i, c in enumerate(df.columns)
    ]
    return row.select(F.inline(F.array(*kinds)))


def dataset_profile(df: DataFrame, filename: str, source: str = "default", list_countries: bool = True) -> DataFrame:
    """One row per dataset with its columns by kind, rows, countries and year range.

    The countries are one cell; without ``list_countries`` they are left out, for ``distinct_values`` to list.
    """
    of = lambda kind: F.transform(
        F.filter("_k", lambda k: k["kind"] == kind), lambda k: k["column"]
    )
    # One row per column of the table, so the list is as long as the schema.
    kinds = column_kinds(df).agg(F.array_sort(F.collect_list(F.struct("position", "column", "kind"))).alias("_k"))
    row = df.agg(
        F.count("*").alias("row_count"),
        *([F.array(F.min("Year"), F.max("Year")).alias("year_range")] if "Year" in df.columns else []),
    )
    out = row.withColumn("_k", kinds.scalar()).select(
        F.lit(source).alias("active_source"),
        F.lit(filename).alias("filename"),
        "row_count",
        F.transform("_k", lambda k: k["column"]).alias("columns"),
        of("numeric").alias("numeric_columns"),
        of("categorical").alias("categorical_columns"),
        of("date").alias("date_columns"),
        *(["year_range"] if "Year" in df.columns else []),
    )
    if "Country" not in df.columns or not list_countries:
        return out
    return out.withColumn("countries", distinct_names(df, "Country").select("names").scalar())


def category_statistics(df: DataFrame, category: str, columns=None) -> DataFrame:
    """Mean, min, max and std of every numeric column per category, one row per pair.

    The wide aggregation runs first; only its result is unpivoted.
    """
    columns = columns or [c for c, t in df.dtypes if is_numeric(t) and c != category]
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                mean(F.col(c)).alias("mean"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.stddev_samp(v).alias("std"),
            ).alias(f"_{c}")
        )
    wide = df.where(F.col(category).isNotNull()).groupBy(category).agg(*aggs)
    return wide.select(category, F.inline(F.array(*[f"_{c}" for c in columns])))


def top_rows_per_column(df: DataFrame, columns, ties, n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest value of each numeric column.

    A top-k per column keeps ``n`` rows per task; a window over unpivoted rows
    would sort the table once per column.
    """
    parts = []
    for c in columns:
        order = [F.desc(c), *[F.asc(t) for t in ties]]
        top = df.where(F.col(c).isNotNull()).orderBy(*order).limit(n)
        parts.append(top.select(F.lit(c).alias("ranked_by"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_report(clean: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One row: rows and countries processed, year range, and which column was taken for what."""
    detected = ", ".join(f"{std}={name}" for std, name in mapping.items())
    return _by_place_and_year(clean).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_processed"),
        F.countDistinct("Country").alias("countries"),
        F.min("Year").alias("first_year"),
        F.max("Year").alias("last_year"),
        F.lit(detected).alias("columns_detected"),
    )
