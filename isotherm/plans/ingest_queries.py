"""Reading, cleaning and writing tables."""

from functools import reduce

from pyspark.sql import functions as F

from isotherm.functions import numbers
from isotherm.functions.text import squeeze
from isotherm.operators import cleaning, profile, selection, trends
from isotherm.plans.catalog import query
from isotherm.plans.oracle import number
from isotherm.plans.panel_queries import FASTEST, HOTTEST
from isotherm.plans.oracle import squeeze as sql_squeeze
from isotherm.plans.reports import build_bundle
from isotherm.schemas import RAW_PANEL
from isotherm.session import materialize
from isotherm.sources import bundle, delimited, sinks, uploads

MESSY_HEADERS = {"Country": " country ", "Region": "REGION", "Year": "year", "AvgTemperature": " avg_temp  "}
UNITS = "'Ã‚Â°C|Â°C|Ã‚Â°|Â°|°C|°|degrees|degree|deg'"

MEASURE = number(f"replace(regexp_replace(AvgTemperature, {UNITS}, '', 'g'), ',', '')")
UPLOAD_MEASURE = number("replace(regexp_replace(AvgTemperature, '°C|degrees|degree|deg', '', 'g'), ',', '')")
DEFAULT_MEASURE = number("replace(regexp_replace(AvgTemperature, 'Ã‚Â°C|Â°C|Ã‚Â°|Â°|°C|°', '', 'g'), ',', '')")
YEAR = f"CAST(trunc({number('Year')}) AS INTEGER)"


def clean_sql(measure: str = MEASURE) -> str:
    """The clean panel as CTE ``clean``."""
    return f""", parsed AS (
      SELECT o_orderkey, {sql_squeeze('Country')} AS Country, {sql_squeeze('Region')} AS Region, {YEAR} AS Year, {measure} AS v FROM dirty),
    clean AS (
      SELECT o_orderkey, p.Country, coalesce(canon_region, p.Region) AS Region, Year, v AS AvgTemperature
      FROM parsed p LEFT JOIN canon c ON p.Country = c.Country
      WHERE Year IS NOT NULL AND p.Country IS NOT NULL AND v IS NOT NULL)"""


SUMMARY_SQL = """ SELECT Country, Region, Year, count(*) AS n_rows, min(AvgTemperature) AS lowest, max(AvgTemperature) AS highest
    FROM clean GROUP BY Country, Region, Year"""


def summary(clean):
    return clean.groupBy("Country", "Region", "Year").agg(
        F.count("*").alias("n_rows"), F.min("AvgTemperature").alias("lowest"), F.max("AvgTemperature").alias("highest")
    )


def messy(w):
    return w.dirty.select(*[F.col(c).alias(name) for c, name in MESSY_HEADERS.items()])


def upload_folder(w):
    """The dirty panel written as delimited files with one header."""
    path = w.work_path("uploads")
    rows = w.dirty.select(*MESSY_HEADERS)
    rows.write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)
    return path


# Headers of uploads by remainder of the key: column names in file order; the last one lacks the region.
UPLOAD_HEADERS = [
    {"Country": "Country", "Region": "Region", "Year": "Year", "AvgTemperature": "AvgTemperature"},
    {" Year": "Year", "temperature": "AvgTemperature", "COUNTRY": "Country", "region ": "Region"},
    {"note, free": None, "Region": "Region", "avg_temp": "AvgTemperature", "Country": "Country", "year": "Year"},
    {"Year": "Year", "Country": "Country", "AvgTemp": "AvgTemperature"},
]


def mixed_uploads(w):
    """The dirty panel as an upload folder whose files have different headers; names tell the header."""
    path = w.work_path("mixed-uploads")
    for i, header in enumerate(UPLOAD_HEADERS):
        rows = w.dirty.where(F.col("o_orderkey") % len(UPLOAD_HEADERS) == i)
        shown = [(F.lit('x, "y"') if c is None else F.col(c)).alias(name) for name, c in header.items()]
        part = rows.select(*shown).write.option("header", True).option("quoteAll", True).option("emptyValue", "")
        part.option("escape", '"').csv(f"{path}/kind{i}")
    return f"{path}/*"


def kind_of_file():
    return F.regexp_extract("file", "/kind([0-9]+)/", 1).cast("int").alias("kind")


CANONICAL = "SELECT o_orderkey % 4 AS kind, Country, Region, Year, AvgTemperature FROM dirty WHERE o_orderkey % 4 <> 3 AND NOT (Country IS NULL AND Region IS NULL AND Year IS NULL AND AvgTemperature IS NULL)"


@query(
    "src01_csv_scan",
    clean_sql() + """, loaded AS (
      SELECT o_orderkey, p.Country, coalesce(canon_region, p.Region) AS Region, v FROM parsed p LEFT JOIN canon c ON p.Country = c.Country
      WHERE NOT (p.Country IS NULL AND p.Region IS NULL AND p.Year IS NULL AND v IS NULL))
    SELECT Country, Region, count(*) AS n_rows, count(v) AS n_values, min(v) AS lowest, max(v) AS highest FROM loaded GROUP BY Country, Region""",
)
def _(w):
    table = delimited.read_table(w.spark, upload_folder(w), RAW_PANEL)
    v = F.col("AvgTemperature")
    return table.dropna("all").groupBy("Country", "Region").agg(
        F.count("*").alias("n_rows"), F.count(v).alias("n_values"), F.min(v).alias("lowest"), F.max(v).alias("highest")
    )


@query("src02_missing_source", "SELECT Country, Region, Year, AvgTemperature FROM dirty")
def _(w):
    absent = delimited.read_table(w.spark, w.work_path("absent"), RAW_PANEL)
    return w.dirty.select(*absent.columns).unionByName(absent)


# Table of a dataset -> (its SQL source, keys, one of its values).
BUNDLE = {
    "main": ("yearly", "Country, Region, CAST(Year AS VARCHAR)", "TotalTempChange"),
    "country_trends": ("country_trends", "Country, Region, CAST(HottestYear AS VARCHAR)", "WarmingTrendPerYear"),
    "regional_trends": ("regional_trends", "Region, CAST(FirstYear AS VARCHAR), CAST(LatestYear AS VARCHAR)", "RegionalWarmingTrendPerYear"),
    "fastest_regions": (f"({FASTEST})", "Region, CAST(FirstYear AS VARCHAR), CAST(LatestYear AS VARCHAR)", "RegionalTemperatureChange"),
    "hottest_countries": (f"({HOTTEST})", "Country, Region, CAST(HottestYear AS VARCHAR)", "LatestTemperature"),
    "raw": ("dirty", "Country, Region, Year, AvgTemperature", "length(AvgTemperature)"),
}


@query(
    "src03_dataset_bundle",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, concat_ws('|', {keys}) AS entity, CAST({value} AS DOUBLE) AS value FROM {source}" for name, (source, keys, value) in BUNDLE.items()
    ),
)
def _(w):
    """Every row of all six tables after they were written and loaded again, by its keys and one of its values."""
    root = w.work_path("datasets")
    tables = build_bundle(w.panel)
    tables["main"] = tables.pop("yearly")
    tables["raw"] = w.dirty.select(*RAW_PANEL.names)
    bundle.write_dataset(tables, root, "default")
    bundle.load_dataset(w.spark, root, "default")
    parts = [
        w.spark.table(name).select(
            F.lit(name).alias("name"), F.expr(f"concat_ws('|', {keys.replace('VARCHAR', 'STRING')})").alias("entity"),
            F.expr(value).cast("double").alias("value"),
        )
        for name, (_, keys, value) in BUNDLE.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("src04_upload_folder", CANONICAL.replace("Country, Region, Year, AvgTemperature FROM", "nullif(trim(Country), '') AS Country, nullif(trim(Region), '') AS Region, nullif(trim(Year), '') AS Year, nullif(trim(AvgTemperature), '') AS AvgTemperature FROM"))
def _(w):
    lines = uploads.upload_lines(w.spark.read.text(mixed_uploads(w)))
    headers = uploads.upload_headers(lines)
    kinds = headers.select("dataset_id", kind_of_file())
    rows = uploads.panel_rows(lines, headers).dropna("all", subset=RAW_PANEL.names).join(kinds, "dataset_id")
    return rows.select("kind", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in RAW_PANEL.names])


@query(
    "src04_upload_report",
    """ SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Country=country, Region=region, Year=year, AvgTemperature=avgtemperature' WHEN 1 THEN 'Country=country, Region=region, Year=year, AvgTemperature=temperature'
      WHEN 2 THEN 'Country=country, Region=region, Year=year, AvgTemperature=avg_temp' ELSE 'Country=country, Year=year, AvgTemperature=avgtemp' END AS columns_detected,
      CASE WHEN o_orderkey % 4 = 3 THEN 'Region' ELSE '' END AS missing, sum(CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END)::BIGINT AS n_rows FROM dirty GROUP BY 1, 2""",
)
def _(w):
    report = uploads.upload_report(w.spark, mixed_uploads(w))
    return report.groupBy("columns_detected", "missing").agg(F.sum("n_rows").alias("n_rows"))


@query("src05_select_dataset", "SELECT * FROM country_trends")
def _(w):
    path = w.work_path("trends")
    trends_table = materialize(w.country_trends)
    sinks.write_table(trends_table, path, "default")
    sinks.write_table(trends_table.limit(3), path, "upload")
    return delimited.select_dataset(w.spark.read.parquet(path), "default").drop("dataset_id")


@query("snk01_write_tables", "SELECT *, 'upload' AS dataset_id FROM regional_trends")
def _(w):
    path = w.work_path("regions")
    sinks.write_table(w.regional_trends.limit(2), path, "upload")
    sinks.write_table(w.regional_trends, path, "upload")
    return w.spark.read.parquet(path)


@query(
    "snk02_write_profile",
    """ SELECT 'panel.csv' AS filename, count(*) AS row_count, 'Country, Region, Year, AvgTemperature' AS columns,
      'Year, AvgTemperature' AS numeric_columns, 'Country, Region' AS categorical_columns,
      min(Year) AS first_year, max(Year) AS last_year, (SELECT string_agg(Country, ', ' ORDER BY Country) FROM (SELECT DISTINCT Country FROM means)) AS countries FROM means""",
)
def _(w):
    path = w.work_path("profile")
    sinks.write_profile(profile.dataset_profile(w.means, "panel.csv"), path)
    back = w.spark.read.json(path)
    joined = lambda c: F.array_join(c, ", ").alias(c)
    return back.select(
        "filename", "row_count", joined("columns"), joined("numeric_columns"), joined("categorical_columns"),
        F.get("year_range", 0).alias("first_year"), F.get("year_range", 1).alias("last_year"), joined("countries"),
    )


@query(
    "snk03_export_search",
    "SELECT p_name, p_brand, format('{:.3f}', p_retailprice) AS p_retailprice FROM part WHERE contains(lower(p_name), 'ring')",
)
def _(w):
    path = w.work_path("export")
    named = w.table("part").select("p_name", "p_brand", F.format_string("%.3f", "p_retailprice").alias("p_retailprice"))
    sinks.export_search(named, "Ring", path)
    return w.spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "snk04_json_records",
    "SELECT location, day, coalesce(tmean, 0) AS tmean, coalesce(rain, 0) AS rain FROM (SELECT location, strftime(day, '%Y-%m-%d') AS day, tmean, rain FROM daily)",
)
def _(w):
    rows = w.daily.select("location", F.date_format("day", "yyyy-MM-dd").alias("day"), "tmean", "rain")
    parsed = F.from_json("record", "location string, day string, tmean double, rain double")
    return sinks.records(rows).select(parsed.alias("r")).select("r.*")


@query("prj01_clean_headers", clean_sql() + SUMMARY_SQL)
def _(w):
    trimmed = cleaning.clean_headers(messy(w))
    renamed = trimmed.toDF("Country", "Region", "Year", "AvgTemperature")
    return summary(cleaning.clean_panel(renamed))


@query("prj02_find_columns", "SELECT Country, Region, Year, AvgTemperature FROM dirty")
def _(w):
    mapping = cleaning.panel_mapping(cleaning.clean_headers(messy(w)))
    return cleaning.clean_headers(messy(w)).select(*[F.col(c).alias(std) for std, c in mapping.items()])


@query(
    "prj03_required_columns",
    "SELECT count(*) AS n_rows, 'Country, Region, Year, AvgTemperature' AS found FROM dirty",
)
def _(w):
    rows = cleaning.clean_headers(messy(w))
    found = ", ".join(cleaning.panel_mapping(rows))
    return rows.agg(F.count("*").alias("n_rows"), F.lit(found).alias("found"))


@query("prj04_canonical_names", "SELECT Country, Region, Year, AvgTemperature FROM dirty")
def _(w):
    return cleaning.canonical_columns(cleaning.clean_headers(messy(w)))


@query("prj05_text_normalise", f"SELECT o_orderkey, {sql_squeeze('Country')} AS Country, {sql_squeeze('Region')} AS Region FROM dirty")
def _(w):
    return cleaning.clean_texts(w.dirty).select("o_orderkey", "Country", "Region")


@query("prj06_measure_default", f"SELECT o_orderkey, {DEFAULT_MEASURE} AS v FROM dirty")
def _(w):
    return w.dirty.select("o_orderkey", numbers.parse_measure(F.col("AvgTemperature"), numbers.DEFAULT_UNITS).alias("v"))


@query("prj07_measure_upload", f"SELECT o_orderkey, {UPLOAD_MEASURE} AS v FROM dirty")
def _(w):
    return w.dirty.select("o_orderkey", numbers.parse_measure(F.col("AvgTemperature"), numbers.UPLOAD_UNITS).alias("v"))


_BARE = "regexp_replace(regexp_replace(AvgTemperature, '(?i)°|degrees?|deg|c', '', 'g'), '[,\\s]', '', 'g')"


@query(
    "prj08_coerce_measures",
    f"SELECT o_orderkey, {sql_squeeze('Country')} AS Country, {sql_squeeze('Year')} AS Year, "
    f"coalesce({number(_BARE)}, {number(f'''regexp_replace({_BARE}, '[^0-9.-]', '', 'g')''')}) AS AvgTemperature FROM dirty",
)
def _(w):
    return cleaning.coerce_measures(w.dirty).select("o_orderkey", "Country", "Year", "AvgTemperature")


@query("prj09_year_parse", f"SELECT o_orderkey, {YEAR} AS Year FROM dirty WHERE {YEAR} IS NOT NULL")
def _(w):
    return w.dirty.select("o_orderkey", numbers.parse_year(F.col("Year")).alias("Year")).dropna(subset=["Year"])


@query(
    "prj10_finite_values",
    "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS value FROM events",
)
def _(w):
    kind = F.col("event_type")
    odd = F.when(kind == "error", F.lit(float("inf"))).when(kind == "view", F.lit(float("nan")))
    return cleaning.finite_columns(w.events.select("event_id", F.coalesce(odd, "value").alias("value")))


@query("prj12_pick_columns", "SELECT Region, Country, AverageTemperature FROM country_trends")
def _(w):
    table = w.country_trends.select("Region", "Country", "AverageTemperature")
    category, measure = selection.pick_columns(table.select("Country", "AverageTemperature"))
    return table.select("Region", category, measure)


@query("prj13_existing_columns", "SELECT Country, VolatilityScore FROM country_trends ORDER BY VolatilityScore DESC, Region, Country LIMIT 20")
def _(w):
    order = [F.desc("VolatilityScore"), F.asc("Region"), F.asc("Country")]
    return selection.project_existing(w.country_trends, ["Country", "Population", "VolatilityScore"], 20, order)


@query("flt01_drop_empty", "SELECT Country, Region, Year, AvgTemperature FROM dirty WHERE o_orderkey % 97 <> 0")
def _(w):
    return cleaning.drop_empty_rows(w.dirty.drop("o_orderkey"))


@query("flt02_drop_incomplete", "SELECT o_orderkey FROM dirty WHERE Country IS NOT NULL AND Region IS NOT NULL AND Year IS NOT NULL")
def _(w):
    return cleaning.drop_incomplete_rows(w.dirty, ["Country", "Region", "Year", "Month"]).select("o_orderkey")


@query("jn01_region_corrections", "SELECT o_orderkey, p.Country, coalesce(canon_region, p.Region) AS Region FROM priced p LEFT JOIN canon c ON p.Country = c.Country")
def _(w):
    return cleaning.apply_region_corrections(w.priced).select("o_orderkey", "Country", "Region")


@query("prj_clean_panel", clean_sql() + SUMMARY_SQL)
def _(w):
    return summary(cleaning.clean_panel(messy(w)))


@query("prj_clean_upload", clean_sql(UPLOAD_MEASURE) + SUMMARY_SQL)
def _(w):
    return summary(cleaning.clean_panel_upload(messy(w)))


@query(
    "ag24_run_report",
    clean_sql() + """ SELECT count(*) AS rows_processed, count(DISTINCT Country) AS countries, min(Year) AS first_year, max(Year) AS last_year,
      'Country=country, Region=REGION, Year=year, AvgTemperature=avg_temp' AS columns_detected FROM clean""",
)
def _(w):
    rows = cleaning.clean_headers(messy(w))
    return profile.run_report(cleaning.clean_panel(rows), cleaning.panel_mapping(rows))
