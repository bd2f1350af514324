"""Writing result tables, profiles, exports and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.numbers import display_value, finite
from isotherm.operators.selection import search_rows


def write_table(df: DataFrame, path: str, dataset_id: str) -> None:
    """Write a table as the partition ``dataset_id``, replacing only that partition."""
    (
        df.withColumn("dataset_id", F.lit(dataset_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )


def write_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def export_search(df: DataFrame, text: str, path: str) -> None:
    """The rows a search finds, as shown, as a delimited file with quoting."""
    shown = search_rows(df, text).select(*[display_value(F.col(c), t).alias(c) for c, t in df.dtypes])
    shown.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def records(df: DataFrame) -> DataFrame:
    """Rows as JSON records, with NaN, infinite and missing values as 0.

    A missing value is written as null and then read as 0: a quote inside a text
    is always escaped, so an unescaped one before ``:null`` ends a field name.
    """
    clean = [finite(F.col(c)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes]
    record = F.to_json(F.struct(*clean), {"ignoreNullFields": "false"})
    return df.select(F.regexp_replace(record, r'(?<!\\)":null(?=[,}])', '":0').alias("record"))
