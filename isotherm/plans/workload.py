"""The library's logical tables, derived by Spark from the given parquet tables.

Expressions that mean the same in Spark and ANSI SQL are kept as text, so that the
oracle derives the same inputs; what the operators do with them is written twice.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.distributed import settled, spread
from isotherm.functions.numbers import mean, rint_to
from isotherm.operators.cleaning import apply_region_corrections
from isotherm.operators.linking import dictionary
from isotherm.operators.panel import build_yearly, yearly_means
from isotherm.operators.trends import country_trends, regional_trends
from isotherm.session import materialize, new_work_path

AS_OF = "2024-06-30"

# Country names of the nation keys; 5 and 16 keep the name in the table.
NATION_NAMES = {
    0: "Algeria", 1: "Argentina", 2: "Brazil", 3: "Canada", 4: "Egypt", 6: "France",
    7: "Germany", 8: "India", 9: "Indonesia", 10: "Iran", 11: "Iraq", 12: "Japan",
    13: "Jordan", 14: "Kenya", 15: "Morocco", 17: "Peru", 18: "China", 19: "Romania",
    20: "Saudi Arabia", 21: "Vietnam", 22: "Russia", 23: "United Kingdom", 24: "United States",
}
REGION_NAMES = ["Africa", "Asia", "Europe", "Middle East", "North America", "Oceania", "South America"]


def case_of(key: str, values: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items())
    return f"CASE {key} {whens} ELSE {default} END"


def pick_of(index: str, values) -> str:
    """The value at a zero-based index, in SQL both engines read."""
    return f"split_part('{'|'.join(values)}', '|', CAST({index} + 1 AS INT))"


COUNTRY = case_of("n_nationkey", NATION_NAMES, "n_name")

# A panel as text with deterministic damage, from (o_orderkey, Country, Region, y, v).
DIRTY = {
    "Country": "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '  ' || Country || ' ' "
    "WHEN o_orderkey % 5 = 1 THEN replace(Country, ' ', '   ') ELSE Country END",
    "Region": "CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 13 = 0 THEN NULL "
    "WHEN o_orderkey % 5 = 2 THEN ' ' || Region ELSE Region END",
    "Year": "CASE WHEN o_orderkey % 97 = 0 OR o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN y || '.0' "
    "WHEN o_orderkey % 11 = 1 THEN substr(y, 1, 2) || 'x' || substr(y, 4) ELSE y END",
    "AvgTemperature": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CASE o_orderkey % 12 WHEN 0 THEN v || ' °C' "
    "WHEN 1 THEN v || 'Â°C' WHEN 2 THEN ' ' WHEN 3 THEN v || ' degree' WHEN 4 THEN 'nan' WHEN 5 THEN 'inf' "
    "WHEN 6 THEN substr(v, 1, length(v) - 6) || ',' || substr(v, length(v) - 5) WHEN 7 THEN 'abc' "
    "WHEN 8 THEN ' ' || v || ' deg' ELSE v END END",
}

# Questions templated from events: two countries, a region, a year and a number per event.
_NAMES_IN_TEXT = [NATION_NAMES.get(k, f"NATION_{k}") for k in range(25)]
QUESTION_PARTS = {
    "c1": pick_of("event_id % 25", _NAMES_IN_TEXT),
    "c2": pick_of("(event_id * 7 + 3) % 25", _NAMES_IN_TEXT),
    "r1": pick_of("event_id % 7", REGION_NAMES),
    "y1": "CAST(1995 + event_id % 8 AS VARCHAR(4))",
    "n1": "CAST(3 + event_id % 20 AS VARCHAR(4))",
}
TEMPLATES = [
    "'Top ' || n1 || ' hottest countries'",
    "'Compare ' || c1 || ' and ' || c2",
    "'What was the weather in ' || c1 || ' in ' || y1 || '?'",
    "'temperature in ' || c1 || ' on 20th December 1995'",
    "'How many countries are in the dataset?'",
    "'Why is that?'",
    "'Summarize ' || r1",
    "'Which ' || n1 || ' regions are fastest warming'",
    "c1 || ' vs ' || c2 || ': average temperature this year'",
    "'Is it going to rain today in ' || c1 || '?'",
    "'Tell me more about this region'",
    "'weather and climate for ' || c1 || ' today'",
    "'show me ' || n1 || ' coldest countries in ' || r1",
    "'usa vs uk warming trend, ' || c1 || ' and ' || c2",
    "'Rainfall at ' || c1 || ' on 2003-02-30'",
    "'humidity in ' || c1 || ' March 2023'",
    "'standard deviation of the temperature, lowest ' || n1 || ' rows'",
    "'last 5 years'",
    "CASE WHEN event_id % 2 = 0 THEN 'Hello there' ELSE 'Saudi Arabbia please' END",
    "'climate change in ' || substr(c1, 1, 2) || substr(c1, 4) || ' versus ' || substr(r1, 1, 3) || substr(r1, 5)",
    "'forecast for ' || c1 || ' from 12/05/2031 or 05/12/2001'",
    "'What about ' || c1 || '?'",
    "'list all regions, ' || c2 || ', ' || c1 || ' and ' || r1",
    "'details on the ' || r1 || ' trend from 1996 to 1999, december 20, 1997'",
    "'london or tokyo: 12 records of 2022 July'",
]
QUESTION = (
    "CASE event_id % 25 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEMPLATES)) + " END"
)

# A number for each pair of conversation and turn: no two pairs share one, and none is a question's.
TURN_ID = "-((((conv_id + turn) * (conv_id + turn + 1)) >> 1) + turn + 1)"

EVENT_CODES = {"view": 61, "click": 0, "purchase": 3, "signup": 2, "error": 95}
EVENT_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_CODES.items()) + " END"


class Workload:
    """Lazily derived tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def work_path(self, name: str) -> str:
        return new_work_path(self.spark, name)

    @cached_property
    def priced(self) -> DataFrame:
        """Orders with the country and region of their customer."""
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.expr(COUNTRY).alias("Country"), F.col("r_name").alias("Region"))
        buyers = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        return (
            self.table("orders")
            .join(buyers.select("c_custkey", "Country", "Region"), F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "o_orderkey",
                "Country",
                "Region",
                F.year("o_orderdate").alias("Year"),
                F.col("o_totalprice").cast("decimal(18,2)").alias("AvgTemperature"),
            )
        )

    @cached_property
    def panel(self) -> DataFrame:
        return apply_region_corrections(self.priced.drop("o_orderkey"))

    @cached_property
    def dirty(self) -> DataFrame:
        rows = self.priced.select(
            "o_orderkey", "Country", "Region",
            F.col("Year").cast("string").alias("y"), F.col("AvgTemperature").cast("string").alias("v"),
        )
        return rows.select("o_orderkey", *[F.expr(e).alias(c) for c, e in DIRTY.items()])

    @cached_property
    def means(self) -> DataFrame:
        return yearly_means(self.panel)

    @cached_property
    def yearly(self) -> DataFrame:
        return build_yearly(self.panel)

    @cached_property
    def country_trends(self) -> DataFrame:
        return country_trends(self.means)

    @cached_property
    def regional_trends(self) -> DataFrame:
        return regional_trends(self.means)

    @cached_property
    def ready_means(self) -> DataFrame:
        """Yearly means, materialized: small, and read several times."""
        return materialize(self.means)

    @cached_property
    def ready_countries(self) -> DataFrame:
        return materialize(country_trends(self.ready_means))

    @cached_property
    def ready_regions(self) -> DataFrame:
        return materialize(regional_trends(self.ready_means))

    @cached_property
    def names(self) -> DataFrame:
        means = self.ready_means
        return dictionary((means, "Country", "Country"), (means, "Region", "Region"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def daily(self) -> DataFrame:
        value = F.col("value").cast("decimal(18,2)")
        kind = F.col("event_type")
        of = lambda *types: F.sum(F.when(kind.isin(*types), value)).cast("double")
        return self.events.groupBy(
            F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("location"),
            F.to_date("ts").alias("day"),
        ).agg(
            F.max("value").alias("tmax"),
            F.min("value").alias("tmin"),
            F.when(F.count("*") % 4 != 0, rint_to(mean(value), 2)).alias("tmean"),
            of("view", "error").alias("precipitation"),
            of("view").alias("rain"),
            F.max(F.when(kind == "click", F.col("value"))).alias("wind"),
            F.min(F.expr(EVENT_CODE)).alias("code"),
        )

    @cached_property
    def questions(self) -> DataFrame:
        """``qid, conv_id, turn, text``: one question per event."""
        events = spread(self.events.select("event_id", "user_id"))
        parts = events.select("event_id", "user_id", *[F.expr(e).alias(c) for c, e in QUESTION_PARTS.items()])
        return settled(parts.select(
            F.col("event_id").alias("qid"),
            F.col("user_id").alias("conv_id"),
            F.col("event_id").alias("turn"),
            F.expr(QUESTION).alias("text"),
        ))

    @cached_property
    def texts(self) -> DataFrame:
        """``qid, text``: the questions and every whole conversation turn."""
        turns = settled(spread(self.table("conversations")).select(F.expr(TURN_ID).alias("qid"), "text"))
        return self.questions.select("qid", "text").unionByName(turns)

    @cached_property
    def observations(self) -> DataFrame:
        """Readings with a country name, of which one in 25 is only a part of a name."""
        return self.events.select(
            "event_id", "ts", F.expr(QUESTION_PARTS["c1"]).alias("c1"), "value"
        ).select("event_id", "ts", F.upper("c1").alias("country"), F.col("value").alias("temperature_c"))
