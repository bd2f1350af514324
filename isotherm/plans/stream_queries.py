"""Structured Streaming over the given tables, each run to the end of its input."""

from pyspark.sql import functions as F

from isotherm.plans.catalog import query
from isotherm.plans.ingest_queries import clean_sql, kind_of_file, mixed_uploads
from isotherm.plans.oracle import r
from isotherm.plans.rollup_queries import rollup_sql
from isotherm.plans.text_queries import ROUTES, as_of
from isotherm.plans.workload import EVENT_CODE, QUESTION, QUESTION_PARTS
from isotherm.sources import uploads
from isotherm.operators.compare import against_history
from isotherm.streaming.conversation import route_conversations
from isotherm.streaming.ingest import ingest_uploads
from isotherm.streaming.rollup import daily_summaries, period_summaries
from isotherm.streaming.run import run_available


def event_stream(w):
    schema = w.events.schema
    files = w.spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    return files.parquet(f"{w.sf_dir}/events*.parquet")


@query(
    "st01_stream_ingest",
    clean_sql() + """ SELECT o_orderkey % 4 AS kind, Country, Region, Year, AvgTemperature FROM clean WHERE o_orderkey % 4 <> 3
    UNION ALL SELECT 3, 'Region', NULL, NULL, NULL""",
)
def _(w):
    """Every row that was ingested, with the header its file had, and the file kinds that were refused."""
    folder, out = mixed_uploads(w), w.work_path("ingested")
    ingest_uploads(w.spark, folder, out, w.work_path("ingest-log"), files_per_batch=4).awaitTermination()
    files = uploads.upload_headers(uploads.upload_lines(w.spark.read.text(folder))).select("dataset_id", kind_of_file())
    rows = w.spark.read.parquet(out).join(files, "dataset_id").select("kind", "Country", "Region", "Year", "AvgTemperature")
    refused = w.spark.read.parquet(f"{out}-headers").where("missing <> ''").join(files, "dataset_id").select("kind", "missing").distinct()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("Region", "string"), ("Year", "int"), ("AvgTemperature", "double"))]
    return rows.unionByName(refused.select("kind", F.col("missing").alias("Country"), *nothing))


MEAN = "(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value))"
TOTAL = "sum(CAST(CASE WHEN event_type IN ({}) THEN value END AS DECIMAL(28,6)))::DOUBLE"
RAIN, PRECIPITATION, WIND = TOTAL.format("'view'"), TOTAL.format("'view', 'error'"), "max(CASE WHEN event_type = 'click' THEN value END)"


def weather_readings(w, ts):
    """Events as readings: the value is a temperature, and rain, precipitation or wind by the type."""
    of = lambda *types: F.when(F.col("event_type").isin(*types), F.col("value"))
    return event_stream(w).select(
        F.expr(ts).alias("ts"), F.concat(F.lit("L"), F.col("user_id")).alias("location"), "value",
        of("view").alias("rain"), of("view", "error").alias("precipitation"), of("click").alias("wind"), F.expr(EVENT_CODE).alias("code"),
    )


@query(
    "st02_stream_rollup",
    f""", d AS (SELECT 'L' || user_id AS location, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, {r(MEAN, 2)} AS temperature_c,
      max(value) AS max_temperature_c, min(value) AS min_temperature_c, count(value) AS n, {r(RAIN, 2)} AS rain_mm,
      {r(PRECIPITATION, 2)} AS precipitation_mm, {r(WIND, 2)} AS wind_speed_kmh, 1 AS num_days, coalesce(max({EVENT_CODE}), 0) AS weather_code FROM events
      WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY user_id, CAST(ts AS DATE))
    SELECT d.*, coalesce(code_text, 'variable') AS condition, coalesce(rain_mm > 0, false) AS will_rain FROM d LEFT JOIN codes ON code = weather_code""",
)
def _(w):
    return run_available(daily_summaries(weather_readings(w, "ts")), "rollup")


# The events span a month; with an hour for a day they span two years.
STRETCHED = "TIMESTAMP '2024-01-01 00:00:00' + 24 * (ts - TIMESTAMP '2024-01-01 00:00:00')"

for _grain, _format in (("month", "%Y-%m"), ("year", "%Y")):

    @query(
        f"st02_stream_{_grain}s",
        f""", e AS (SELECT * REPLACE ({STRETCHED} AS ts) FROM events),
        d AS (SELECT 'L' || user_id AS location, CAST(ts AS DATE) AS day, {r(MEAN, 2)} AS tmean, max(value) AS tmax, min(value) AS tmin,
          {RAIN} AS rain, {PRECIPITATION} AS precipitation, {WIND} AS wind, max({EVENT_CODE}) AS code FROM e
          WHERE date_trunc('{_grain}', ts) + INTERVAL 1 {_grain} <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR GROUP BY user_id, CAST(ts AS DATE))"""
        + rollup_sql(_format, "d"),
    )
    def _(w, grain=_grain):
        return run_available(period_summaries(weather_readings(w, STRETCHED), grain), "rollup")


@query(
    "st03_stream_enrich",
    f"""SELECT event_id, o.country, temperature_c, AverageTemperature AS historical_avg, {r('temperature_c - AverageTemperature', 3)} AS difference
    FROM observations o LEFT JOIN country_trends t ON lower(o.country) = lower(t.Country)""",
)
def _(w):
    readings = event_stream(w).select(
        "event_id", F.upper(F.expr(QUESTION_PARTS["c1"])).alias("country"), F.col("value").alias("temperature_c")
    )
    return run_available(against_history(readings, "country", "temperature_c", w.ready_countries), "enriched")


STATE_SQL = """, t AS (SELECT conv_id, turn, place, fixed, fixed IS NULL AND follow AS follow, keyword FROM routes r JOIN questions s ON r.qid = s.qid),
    src AS (SELECT *, CASE coalesce(fixed, keyword) WHEN 'historical_weather' THEN 'weather' WHEN 'out_of_scope' THEN NULL ELSE coalesce(fixed, keyword) END AS source FROM t),
    a AS (SELECT *, last_value(CASE WHEN NOT follow THEN source END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM src),
    b AS (SELECT *, first_value(CASE WHEN follow AND anchor IS NULL THEN source END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM a),
    s AS (SELECT *, coalesce(anchor, lead) AS state FROM b),
    ro AS (SELECT conv_id, turn, place, follow, CASE WHEN follow THEN coalesce(CASE state WHEN 'hybrid' THEN 'climate' ELSE state END, keyword) ELSE coalesce(fixed, keyword) END AS route FROM s),
    lf AS (SELECT *, CASE route WHEN 'historical_weather' THEN 'weather' WHEN 'out_of_scope' THEN NULL ELSE route END AS src,
      CASE route WHEN 'climate' THEN '' WHEN 'weather' THEN place WHEN 'out_of_scope' THEN NULL ELSE coalesce(place, '') END AS lft FROM ro)
    SELECT conv_id, turn, follow AS followup, route,
      last_value(src IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_source,
      nullif(last_value(lft IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_place FROM lf"""


@query("st04_stream_conversations", ROUTES + STATE_SQL)
def _(w):
    parts = event_stream(w).select("event_id", "user_id", "ts", *[F.expr(e).alias(c) for c, e in QUESTION_PARTS.items()])
    turns = parts.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.expr(QUESTION).alias("text"), "ts"
    )
    out = w.work_path("answers")
    route_conversations(turns, w.names, as_of(), out, w.work_path("answers-log"), ts="ts").awaitTermination()
    return w.spark.read.parquet(out).select("conv_id", "turn", "followup", "route", "last_source", "last_place")
