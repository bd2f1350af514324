"""Delimited files: one scan, cleaned on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.operators.cleaning import apply_region_corrections, clean_headers, coerce_measures


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches ``path``, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file or folder with a header, every column as text (no inference pass)."""
    header = spark.read.option("header", True).option("inferSchema", False)
    return header.option("enforceSchema", False).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table from a delimited file with measures coerced and regions corrected.

    A path without files gives an empty table with ``schema``.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    cleaned = coerce_measures(clean_headers(read_texts(spark, path)))
    return apply_region_corrections(cleaned)


def list_uploads(uploads: DataFrame) -> DataFrame:
    """The uploads of a folder with their row counts."""
    return uploads.groupBy("dataset_id").agg(F.count("*").alias("n_rows"))


def select_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    """One dataset of a table that is partitioned by ``dataset_id``: other folders are not read."""
    return df.where(F.col("dataset_id") == dataset_id)
