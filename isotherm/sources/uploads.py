"""Folders of uploaded panel files, each with its own header: columns are found by name, file by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.operators.cleaning import PANEL_COLUMNS
from isotherm.session import materialize

LINE = "value string, dataset_id string, file string, start long"


def upload_lines(files: DataFrame) -> DataFrame:
    """``value, dataset_id, file, start`` of text files, batch or stream; ``start`` is where the line's split begins."""
    meta = F.col("_metadata")
    return files.select(
        "value", meta["file_name"].alias("dataset_id"), meta["file_path"].alias("file"), meta["file_block_start"].alias("start")
    )


def _header_cells(line: Column) -> Column:
    """Header cells in lower case, outer quotes and white space taken off; commas inside quotes do not split."""
    cells = F.split(F.regexp_replace(line, "^﻿", ""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(cells, lambda c: F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), '^"|"$', "")), r"\s+", " ")))


def upload_headers(lines: DataFrame) -> DataFrame:
    """One row per file: its header line, where each panel column stands in it (from 0), and which are missing.

    The header is the first line of the file's first split; one aggregation finds it for all files. A written table:
    it is found once, and the optimizer knows that it is small, so no join with it brings a file's lines into one task.
    """
    first = (
        lines.where("start = 0").select("file", "dataset_id", "value", F.monotonically_increasing_id().alias("_n"))
        .groupBy("file", "dataset_id").agg(F.min_by("value", "_n").alias("header"))
    )
    named = first.withColumn("_cells", _header_cells(F.col("header")))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("_cells", n.lower()), F.lit(0)) for n in names]) - 1
    placed = named.select("*", *[place(names).cast("int").alias(f"_{std}") for std, names in PANEL_COLUMNS.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{std}").isNull(), F.lit(std)) for std in PANEL_COLUMNS]))
    return materialize(placed.withColumn("missing", missing), "headers")


def panel_rows(lines: DataFrame, headers: DataFrame, by: str = "dataset_id") -> DataFrame:
    """The panel columns as text, with ``by`` (``dataset_id`` or ``file``), of every file that has them all, whatever their order.

    Cells are parsed by Spark's own parser under as many positions as the widest header has; a file's own
    positions then say which cell is which column. Files with a missing column give no rows: ``upload_report``
    names them. A line equal to its file's header is no data.
    """
    width = headers.agg(F.max(F.size("_cells"))).first()[0] or 1
    places = headers.where(F.size("missing") == 0).select("file", "header", *[f"_{std}" for std in PANEL_COLUMNS])
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)))
    parsed = lines.join(places, "file").where((F.trim("value") != "") & (F.col("value") != F.col("header"))).withColumn("_row", cells)
    listed = parsed.withColumn("_row", F.array(*[F.col(f"_row.c{i}") for i in range(width)]))
    return listed.select(*[F.get("_row", F.col(f"_{std}")).alias(std) for std in PANEL_COLUMNS], by)


def read_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """All uploads of a folder as ``Country, Region, Year, AvgTemperature`` texts; the file name is the ``dataset_id``."""
    lines = upload_lines(spark.read.text(folder))
    return panel_rows(lines, upload_headers(lines))


def upload_report(spark: SparkSession, folder: str) -> DataFrame:
    """``dataset_id, file, columns_detected, missing, n_rows`` of each upload; a file without a required column has no rows.

    Files are told apart by their path, so two of one name in two folders have a row each.
    """
    lines = upload_lines(spark.read.text(folder))
    headers = upload_headers(lines)
    counts = panel_rows(lines, headers, "file").groupBy("file").agg(F.count("*").alias("n_rows"))
    detected = F.concat_ws(", ", *[
        F.when(F.col(f"_{std}").isNotNull(), F.concat(F.lit(f"{std}="), F.get("_cells", F.col(f"_{std}")))) for std in PANEL_COLUMNS
    ])
    return headers.join(counts, "file", "left").select(
        "dataset_id", "file", detected.alias("columns_detected"), F.array_join("missing", ", ").alias("missing"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )
