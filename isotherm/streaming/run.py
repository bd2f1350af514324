"""Running a stream over what is there, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isotherm.session import new_work_path


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drive ``stream`` through all available input and return the table it wrote."""
    path = new_work_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
