"""Incremental ingest: files that arrive in a folder are cleaned and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isotherm.operators.cleaning import clean_panel
from isotherm.schemas import RAW_PANEL
from isotherm.session import temporary_tables
from isotherm.sources.uploads import panel_rows, upload_headers, upload_lines


def ingest_uploads(
    spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Clean the new delimited files of ``folder`` into ``out``, one partition ``batch`` per micro-batch.

    Each file's columns are found by its own header; ``dataset_id`` keeps the file name. A batch that is run
    again after a failure replaces its own partition. ``out``-``headers`` holds each batch's files with the columns
    they miss. Stops when everything that was there has been read; run it again for later files.
    """
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)

    def write(lines: DataFrame, batch: int) -> None:
        with temporary_tables(lines.sparkSession):
            headers = upload_headers(lines)
            rows = clean_panel(panel_rows(lines, headers).dropna("all", subset=RAW_PANEL.names))
            report = headers.select("dataset_id", F.array_join("missing", ", ").alias("missing"))
            for df, path in ((rows, out), (report, f"{out}-headers")):
                keyed = df.withColumn("batch", F.lit(batch)).write.mode("overwrite")
                keyed.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return (
        upload_lines(files)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
