"""The named tables of a dataset, written below one root by table and ``dataset_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isotherm.schemas import DATASET_TABLES
from isotherm.sources.delimited import path_exists, select_dataset
from isotherm.sources.sinks import write_table


def write_dataset(tables: dict[str, DataFrame], root: str, dataset_id: str) -> None:
    """Write the tables of one dataset, ``raw`` (the panel as it was uploaded, as text) among them, replacing only that dataset."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", dataset_id)


def load_table(spark: SparkSession, root: str, name: str, dataset_id: str) -> DataFrame:
    """One table of a dataset; empty with the right columns if it was never written."""
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], DATASET_TABLES[name])
    return select_dataset(spark.read.parquet(path), dataset_id).drop("dataset_id")


def load_dataset(spark: SparkSession, root: str, dataset_id: str, views: bool = True) -> dict[str, DataFrame]:
    """The six tables of a dataset, also as temporary views."""
    tables = {name: load_table(spark, root, name, dataset_id) for name in DATASET_TABLES}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
