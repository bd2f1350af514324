"""From a dirty file to the canonical panel.

The schema half looks at ``df.columns`` only; the row half is a projection and a
filter, so a whole upload is cleaned in one narrow stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.lookups import REGION_OF_COUNTRY, lookup_table
from isotherm.functions.numbers import (
    UPLOAD_UNITS,
    finite,
    parse_loose_number,
    parse_measure,
    parse_year,
)
from isotherm.functions.text import squeeze

# The names under which the four panel columns may come.
PANEL_COLUMNS = {
    "Country": ["country"],
    "Region": ["region"],
    "Year": ["year"],
    "AvgTemperature": ["avgtemp", "avgtemperature", "avg_temp", "temperature"],
}
MEASURE_KEYWORDS = ["temp", "temperature", "warming", "change", "trend"]


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[re.sub(r"\s+", " ", name.strip()) for name in df.columns])


def find_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The column that matches the first candidate with a match, ignoring case."""
    by_name = {name.lower(): name for name in df.columns}
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def panel_mapping(df: DataFrame, required=tuple(PANEL_COLUMNS)) -> dict[str, str]:
    """Which column of ``df`` is which panel column; an error names what is missing."""
    found = {std: find_column(df, names) for std, names in PANEL_COLUMNS.items()}
    missing = [std for std in required if found[std] is None]
    if missing:
        raise ValueError(f"missing required columns: {missing}; found columns: {df.columns}")
    return {std: name for std, name in found.items() if name}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename the panel columns to their canonical names; other columns stay."""
    mapping = panel_mapping(df)
    return df.withColumnsRenamed({name: std for std, name in mapping.items()})


def clean_texts(df: DataFrame, columns=("Country", "Region")) -> DataFrame:
    return df.withColumns({c: squeeze(F.col(c)) for c in columns if c in df.columns})


def coerce_measures(df: DataFrame) -> DataFrame:
    """Squeeze every text column; turn those named like a measure into doubles."""
    changed = {}
    for name, dtype in df.dtypes:
        measure = any(k in name.lower() for k in MEASURE_KEYWORDS)
        if dtype == "string":
            changed[name] = parse_loose_number(F.col(name)) if measure else squeeze(F.col(name))
        elif dtype in ("float", "double"):
            changed[name] = finite(F.col(name))
    return df.withColumns(changed) if changed else df


def finite_columns(df: DataFrame) -> DataFrame:
    """Infinite and NaN values to null in every floating column."""
    changed = {c: finite(F.col(c)) for c, t in df.dtypes if t in ("float", "double")}
    return df.withColumns(changed) if changed else df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def drop_incomplete_rows(df: DataFrame, required) -> DataFrame:
    """Rows with a null in one of the required columns that exist."""
    return df.dropna(subset=[c for c in required if c in df.columns])


def typed_rows(df: DataFrame, measure: Column) -> DataFrame:
    """Year to int and the measure to double; rows without a year go."""
    return df.withColumns({"Year": parse_year(F.col("Year")), "AvgTemperature": measure}).dropna(
        subset=["Year"]
    )


def apply_region_corrections(df: DataFrame) -> DataFrame:
    """The known region of a country replaces the given one; adds Region if it is absent."""
    if "Country" not in df.columns:
        return df
    known = lookup_table(df.sparkSession, REGION_OF_COUNTRY, "Country string, _region string")
    given = F.col("Region") if "Region" in df.columns else F.lit(None).cast("string")
    joined = df.join(F.broadcast(known), "Country", "left")  # 95 fixed rows
    return joined.withColumn("Region", F.coalesce("_region", given)).select(
        *df.columns, *([] if "Region" in df.columns else ["Region"])
    )


def clean_panel(df: DataFrame) -> DataFrame:
    """Any dirty table with the panel columns under known names to the canonical panel."""
    canonical = drop_empty_rows(canonical_columns(clean_headers(df)))
    extra = [c for c in ("dataset_id",) if c in canonical.columns]
    texts = clean_texts(canonical)
    rows = typed_rows(texts, parse_measure(F.col("AvgTemperature").cast("string")))
    rows = drop_incomplete_rows(rows, ["Country", "AvgTemperature"])
    rows = apply_region_corrections(rows)
    return rows.select(*extra, "Country", "Region", "Year", "AvgTemperature")


def clean_panel_upload(df: DataFrame) -> DataFrame:
    """The same with the unit marks uploads use."""
    canonical = drop_empty_rows(canonical_columns(clean_headers(df)))
    rows = typed_rows(
        clean_texts(canonical), parse_measure(F.col("AvgTemperature").cast("string"), UPLOAD_UNITS)
    )
    rows = drop_incomplete_rows(rows, ["Country", "AvgTemperature"])
    return apply_region_corrections(rows).select("Country", "Region", "Year", "AvgTemperature")
