"""Lines, label-value pairs and blocks of marked-up text.

Everything happens inside the row: lines are arrays, so no shuffle is needed.
Arrays are exploded with the outer variants, since for the inner ones the optimizer
adds a filter on the array's size that computes the array a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.numbers import append_unit

# The patterns of a label with its value and of the line types.
LABEL_VALUE = r"^(?:\*\*)?([^:*]+?)(?:\*\*)?\s*[:\-]\s*(.+?)$"

# The field each known label fills.
WEATHER_LABELS = {
    "location": "loc", "temperature": "temp", "feelslike": "feels", "condition": "cond",
    "humidity": "hum", "windspeed": "wind", "wind": "wind", "todaymin": "mn", "min": "mn",
    "todaymax": "mx", "max": "mx", "rain": "rain", "rainfall": "rain",
}
FIELD_UNITS = {"temp": " C", "feels": " C", "wind": " km/h", "mn": " C", "mx": " C", "rain": " mm"}


def text_lines(text: Column) -> Column:
    """Trimmed lines of a text, in order."""
    return F.transform(F.split(text, "\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))


def line_label(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, LABEL_VALUE, 1))


def line_value(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, LABEL_VALUE, 2))


def line_type(line: Column) -> Column:
    """blank / heading / table / rule / bullet / numbered / label_value / prose; a rule is a table line without cells."""
    return (
        F.when(line == "", "blank")
        .when(line.startswith("##"), "heading")
        .when(line.startswith("|") & line.rlike(r"^[|\s\-:]+$"), "rule")
        .when(line.startswith("|"), "table")
        .when(line.rlike(r"^[-•*]\s+"), "bullet")
        .when(line.rlike(r"^[0-9]+[.)]\s+"), "numbered")
        .when((line_label(line) != "") & (line_value(line) != ""), "label_value")
        .otherwise("prose")
    )


def label_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, label, value`` of the label-value lines."""
    return (
        df.select(key, F.posexplode_outer(text_lines(F.col(text))).alias("line_no", "line"))
        .select(key, "line_no", line_label(F.col("line")).alias("label"), line_value(F.col("line")).alias("value"))
        .where("label <> '' AND value <> ''")
    )


def weather_fields(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text with the known weather labels as columns; the last line of a label wins.

    Stays inside the row: a map of the pairs replaces explode + pivot.
    """
    pairs = F.transform(
        text_lines(F.col(text)),
        lambda l: F.struct(
            F.regexp_replace(F.lower(line_label(l)), "[^a-z0-9]+", "").alias("key"), line_value(l).alias("value")
        ),
    )
    headings = F.filter(text_lines(F.col(text)), lambda l: F.lower(l).startswith("## weather"))
    title = F.regexp_replace(F.get(headings, 0), r"(?i)^#+\s*weather\s*[—-]?\s*", "")
    title = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Weather"))
    out = df.select(key, F.reverse(pairs).alias("_pairs"), title.alias("_title"))

    def field_value(field: str) -> Column:
        labels = [label for label, f in WEATHER_LABELS.items() if f == field]
        value = F.get(F.filter("_pairs", lambda p: p["key"].isin(labels) & (p["value"] != "")), 0)["value"]
        if field in FIELD_UNITS:
            return append_unit(value, FIELD_UNITS[field])
        return F.coalesce(value, F.col("_title") if field == "loc" else F.lit("-"))

    columns = [field_value(f).alias(f) for f in dict.fromkeys(WEATHER_LABELS.values())]
    payload = [label for label, f in WEATHER_LABELS.items() if f != "loc"]
    found = F.exists("_pairs", lambda p: p["key"].isin(payload) & (p["value"] != ""))
    return out.where(found).select(key, *columns)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block_no, line_type, first_line, n_lines``: runs of lines of one type.

    Rules belong to the table they stand in and do not count as its lines; rules alone are no block. The positions where the type changes are found in the row; a block ends
    where the next one starts, so the work is linear in the lines of the text.
    """
    read = df.select(key, F.transform(text_lines(F.col(text)), line_type).alias("_read"))
    typed = read.select(key, "_read", F.transform("_read", lambda t: F.when(t == "rule", "table").otherwise(t)).alias("_types"))
    at = lambda i: F.get("_types", i)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_types") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))
    )
    runs = typed.select(key, "_read", "_types", starts.alias("_starts")).select(
        key, "_read", "_types", "_starts", F.posexplode_outer("_starts").alias("_n", "_start")
    )
    runs = runs.where(F.col("_start").isNotNull())
    end = F.coalesce(F.get("_starts", F.col("_n") + 1), F.size("_types"))
    own = F.slice("_read", F.col("_start") + 1, end - F.col("_start"))
    return runs.select(
        key,
        (F.col("_n") + 1).alias("block_no"),
        at(F.col("_start")).alias("line_type"),
        (F.col("_start") + 1).alias("first_line"),
        F.size(F.filter(own, lambda t: t != "rule")).alias("n_lines"),
    ).where("n_lines > 0")


def typed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line_type, line`` with one row per line."""
    lines = df.select(key, F.posexplode_outer(text_lines(F.col(text))).alias("_i", "line"))
    lines = lines.where(F.col("line").isNotNull())
    return lines.select(key, (F.col("_i") + 1).alias("line_no"), line_type(F.col("line")).alias("line_type"), "line")
