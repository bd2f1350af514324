"""Daily observations, landed responses and readings against history."""

from pyspark.sql import functions as F

from isotherm.functions.facts import weather_answer, weather_context, weather_lines
from isotherm.functions.numbers import parse_number
from isotherm.functions.text import period_bounds
from isotherm.operators import compare, linking, rollup
from isotherm.plans.catalog import query
from isotherm.plans.oracle import number, r
from isotherm.plans.workload import AS_OF
from isotherm.sources import weather

METRICS = ["tmax", "tmin", "tmean", "precipitation", "rain", "wind", "code"]


def archive_texts(w):
    """The daily table as archive responses: one JSON text per location and month."""
    day = F.struct("day", *METRICS)
    months = w.daily.groupBy("location", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.array_sort(F.collect_list(day)).alias("d")  # at most 31 days
    )
    arrays = [F.transform("d", lambda x: F.date_format(x["day"], "yyyy-MM-dd")).alias("time")] + [
        F.col(f"d.{c}").alias(m) for c, m in weather.ARCHIVE_METRICS.items()
    ]
    place = F.struct(F.col("location").alias("name"))
    return months.select(
        F.to_json(F.struct(place.alias("location"), F.struct(*arrays).alias("daily")), {"ignoreNullFields": "false"}).alias("value")
    )


@query("src06_archive_days", f"SELECT location, strftime(day, '%Y-%m-%d') AS day, {', '.join(METRICS)} FROM daily")
def _(w):
    path = w.work_path("archive")
    archive_texts(w).write.text(path)
    days = weather.archive_days(weather.read_archive(w.spark, path))
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def rollup_sql(grain_format, daily="daily"):
    mean = lambda c: f"round_even(sum(CAST({c} AS DECIMAL(28,6)))::DOUBLE / count({c}) * 100, 0) / 100"
    total = lambda c: r(f"sum(CAST({c} AS DECIMAL(28,6)))::DOUBLE", 2)
    m = lambda c: r(f"(sum(CAST({c} AS DECIMAL(28,6)))::DOUBLE / count({c}))", 2)
    return f""", p AS (SELECT *, strftime(day, '{grain_format}') AS period FROM {daily}),
    top AS (SELECT location, period, code AS weather_code FROM (
      SELECT location, period, code, row_number() OVER (PARTITION BY location, period ORDER BY count(*) DESC, code) AS rn
      FROM p WHERE code IS NOT NULL GROUP BY location, period, code) WHERE rn = 1),
    s AS (SELECT location, period, coalesce({m('tmean')}, {r(f"({m('tmax')} + {m('tmin')}) / 2", 2)}) AS temperature_c,
        {r('max(tmax)', 2)} AS max_temperature_c, {r('min(tmin)', 2)} AS min_temperature_c, {total('rain')} AS rain_mm,
        {total('precipitation')} AS precipitation_mm, {m('wind')} AS wind_speed_kmh, count(*) AS num_days
      FROM p GROUP BY location, period)
    SELECT s.*, weather_code, coalesce(code_text, 'variable') AS condition, coalesce(rain_mm > 0, false) AS will_rain
    FROM s JOIN top t ON s.location = t.location AND s.period = t.period LEFT JOIN codes ON code = weather_code"""


for _grain, _format in (("day", "%Y-%m-%d"), ("month", "%Y-%m"), ("year", "%Y")):

    @query(f"ag17_rollup_{_grain}", rollup_sql(_format))
    def _(w, grain=_grain):
        return rollup.rollup(w.daily, grain)


@query(
    "ag18_monthly_means",
    f""", m AS (SELECT location, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month_no, strftime(min(day), '%B') AS month,
      sum(CAST(tmean AS DECIMAL(28,6)))::DOUBLE AS a, count(tmean) AS an, sum(CAST(tmax AS DECIMAL(28,6)))::DOUBLE AS b, count(tmax) AS bn FROM daily GROUP BY 1, 2, 3),
    f AS (SELECT *, CASE WHEN sum(an) OVER (PARTITION BY location, year) > 0 THEN a / an ELSE b / bn END AS v,
      CASE WHEN sum(an) OVER (PARTITION BY location, year) > 0 THEN an ELSE bn END AS n FROM m)
    SELECT location, year, month_no, month, {r('v', 2)} AS avg_temp FROM f WHERE n > 0""",
)
def _(w):
    return rollup.monthly_means(w.daily)


@query(
    "ag19_dominant_code",
    """, c AS (SELECT location, strftime(day, '%Y-%m') AS period, code, count(*) AS n FROM daily GROUP BY 1, 2, 3)
    SELECT location, period, code AS weather_code, n AS n_days FROM c
    QUALIFY row_number() OVER (PARTITION BY location, period ORDER BY n DESC, code) = 1""",
)
def _(w):
    return rollup.dominant_code(w.daily, "month")


@query("ag20_will_rain", "SELECT location, strftime(day, '%Y-%m-%d') AS day, coalesce(rain > 0, false) OR coalesce(wind >= 50, false) AS will_rain FROM daily")
def _(w):
    flag = rollup.will_rain(F.col("rain"), F.col("wind"))
    return w.daily.select("location", F.date_format("day", "yyyy-MM-dd").alias("day"), flag.alias("will_rain"))


@query(
    "jn11_code_texts",
    "SELECT event_id, CAST(event_id % 70 AS INTEGER) AS code, coalesce(code_text, 'unknown') AS condition FROM events LEFT JOIN codes ON code = event_id % 70",
)
def _(w):
    coded = w.events.select("event_id", (F.col("event_id") % 70).cast("int").alias("code"))
    return rollup.with_condition(coded, "code")


def forecasts(w):
    """Events as responses of the first shape."""
    one = lambda c: F.array(c)
    v = F.col("value")
    code = (F.col("event_id") % 70).cast("int")
    place = F.struct(F.concat(F.lit("L"), F.col("user_id")).alias("name"), F.lit("Testland").alias("country"), F.lit(1.5).alias("latitude"))
    current = F.struct(
        v.alias("temperature_2m"), (F.col("event_id") % 100).cast("double").alias("relative_humidity_2m"),
        (v - 1).alias("apparent_temperature"), F.lit(0.5).alias("rain"), code.alias("weather_code"), (v * 2).alias("wind_speed_10m"),
    )
    daily = F.struct(
        one(F.date_format("ts", "yyyy-MM-dd")).alias("time"), one(v + 5).alias("temperature_2m_max"), one(v - 5).alias("temperature_2m_min"),
        one(F.when(F.col("event_id") % 3 == 0, v)).alias("rain_sum"),
        one(F.when(F.col("event_id") % 4 != 1, F.col("event_id") % 100)).alias("precipitation_probability_max"), one(code).alias("weather_code"),
    )
    body = F.struct(place.alias("place"), F.lit("UTC").alias("timezone"), current.alias("current"), daily.alias("daily"))
    return w.events.select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def stations(w):
    """Events as responses of the second shape, with numbers as texts."""
    text = lambda c: c.cast("string")
    v = F.col("value")
    place = F.struct(F.concat(F.lit("L"), F.col("user_id")).alias("name"), F.lit("Testland").alias("country"))
    now = F.struct(
        text(v).alias("temp_C"), F.lit("").alias("FeelsLikeC"), text(F.col("event_id") % 100).alias("humidity"), F.lit("n/a").alias("windspeedKmph"),
        F.when(F.col("event_id") % 3 == 0, text(v)).otherwise("0.0").alias("precipMM"), F.lit("113").alias("weatherCode"),
        F.array(F.struct(F.when(F.col("event_id") % 5 == 0, "").otherwise("Sunny").alias("value"))).alias("weatherDesc"),
    )
    day = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("event_id") % 7 != 0, text(v - 5)).alias("mintempC"))
    body = F.struct(place.alias("place"), F.array(now).alias("current_condition"), F.array(day).alias("weather"))
    return w.events.select("event_id", F.to_json(body).alias("body"))


@query(
    "src07_observation_records",
    """, code_of AS (SELECT event_id, coalesce(code_text, 'unknown') AS t FROM events LEFT JOIN codes ON code = event_id % 70)
    SELECT 'forecast' AS shape, e.event_id, 'L' || user_id AS name, strftime(ts, '%Y-%m-%d') AS date, value AS temperature_c, value - 1 AS feels_like_c,
      (e.event_id % 100)::DOUBLE AS humidity, 0.5::DOUBLE AS rain_mm, value * 2 AS wind, (e.event_id % 70)::INTEGER AS weather_code, t AS condition,
      value + 5 AS highest, value - 5 AS lowest, CASE WHEN e.event_id % 3 = 0 THEN value ELSE 0 END AS rain_sum,
      (e.event_id % 3 = 0 AND value > 0) OR coalesce(CASE WHEN e.event_id % 4 <> 1 THEN e.event_id % 100 END >= 50, false) AS will_rain
    FROM events e JOIN code_of c ON e.event_id = c.event_id
    UNION ALL
    SELECT 'station', event_id, 'L' || user_id, strftime(ts, '%Y-%m-%d'), value, NULL, (event_id % 100)::DOUBLE,
      CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END, NULL, 113, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'Sunny' END,
      value, CASE WHEN event_id % 7 <> 0 THEN value - 5 ELSE value END, CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END, event_id % 3 = 0 AND value > 0
    FROM events""",
)
def _(w):
    tagged = lambda df, shape: df.select(F.lit(shape).alias("shape"), "*")
    keys = ["shape", "event_id"]
    records = weather.forecast_records(tagged(forecasts(w), "forecast"), keys, "body").unionByName(
        weather.station_records(tagged(stations(w), "station"), keys, "body")
    )
    return records.select(
        *keys, "location.name", "date", "current.temperature_c", "current.feels_like_c",
        F.col("current.humidity_percent").alias("humidity"), "current.rain_mm", F.col("current.wind_speed_kmh").alias("wind"),
        "current.weather_code", "current.condition", F.col("today.max_temperature_c").alias("highest"),
        F.col("today.min_temperature_c").alias("lowest"), F.col("today.rain_sum_mm").alias("rain_sum"), "today.will_rain",
    )


_TWO = lambda e: f"format('{{:.2f}}', {r(e, 2)})"
# Fields of the station records as texts with two decimals.
STATION_TEXTS = f""", wx AS (SELECT event_id, 'L' || user_id || ', Testland' AS place, 'L' || user_id AS name, strftime(ts, '%Y-%m-%d') AS date, {_TWO('value')} AS t,
  CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'Sunny' END AS cond, {_TWO('(event_id % 100)::DOUBLE')} AS hum,
  {_TWO('CASE WHEN event_id % 7 <> 0 THEN value - 5 ELSE value END')} AS lo, {_TWO('value')} AS hi, {_TWO('CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END')} AS rain FROM events)"""


def weather_records(w):
    rows = weather.station_records(stations(w), ["event_id"], "body")
    return rows.select("event_id", "date", F.struct("location", "current", "today").alias("r"))


@query(
    "sc19_weather_lines",
    STATION_TEXTS + """ SELECT event_id, 'Location: ' || place || chr(10) || 'Date: ' || date || chr(10) || 'Temperature: ' || t || ' C' || chr(10) || 'Feels Like: N/A C' || chr(10)
      || 'Condition: ' || cond || chr(10) || 'Humidity: ' || hum || '%' || chr(10) || 'Wind Speed: N/A km/h' || chr(10) || 'Today Min: ' || lo || ' C' || chr(10)
      || 'Today Max: ' || hi || ' C' || chr(10) || 'Rain: ' || rain || ' mm' AS lines FROM wx""",
)
def _(w):
    return weather_records(w).select("event_id", weather_lines("r", F.col("date"), 2).alias("lines"))


@query(
    "sc19_weather_answer",
    STATION_TEXTS + """ SELECT event_id, 'Weather Analysis' || chr(10) || chr(10) || 'Location: ' || place || chr(10) || 'Temperature: ' || t || '°C' || chr(10)
      || 'Feels like: N/A°C' || chr(10) || 'Condition: ' || cond || chr(10) || 'Humidity: ' || hum || '%' || chr(10) || 'Wind: N/A km/h' || chr(10) || chr(10)
      || 'Forecast:' || chr(10) || 'Min: ' || lo || '°C' || chr(10) || 'Max: ' || hi || '°C' || chr(10) || 'Rain: ' || rain || ' mm' || chr(10) AS answer FROM wx""",
)
def _(w):
    return weather_records(w).select("event_id", weather_answer("r", 2).alias("answer"))


@query(
    "sc19_weather_context",
    STATION_TEXTS + """ SELECT event_id, chr(10) || 'Location: ' || name || ', Testland' || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'Historical weather on ' || date ELSE 'Current conditions' END
      || chr(10) || chr(10) || 'Temperature: ' || t || '°C' || chr(10) || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Feels Like: None°C' END || chr(10) || 'Condition: ' || cond || chr(10)
      || CASE WHEN event_id % 2 = 0 THEN '' ELSE 'Humidity: ' || hum || '%' END || chr(10) || 'Wind Speed: None km/h' || chr(10) || chr(10) || 'Daily Summary:' || chr(10)
      || 'Min Temp: ' || lo || '°C' || chr(10) || 'Max Temp: ' || hi || '°C' || chr(10) || 'Rain: ' || rain || ' mm' || chr(10) AS context FROM wx""",
)
def _(w):
    historical = F.col("event_id") % 2 == 0
    return weather_records(w).select("event_id", weather_context("r", F.col("date"), historical, 2).alias("context"))


@query(
    "prj14_normalized_record",
    """SELECT event_id, 'L' || user_id AS name, value AS temperature_c, (event_id % 100)::DOUBLE AS humidity_percent,
      CASE WHEN event_id % 2 = 0 THEN 'sunny' ELSE 'cloudy' END AS condition, CASE WHEN event_id % 3 <> 2 THEN value - 5 END AS lowest FROM events""",
)
def _(w):
    v = F.col("value")
    alternative = F.col("event_id") % 3
    current = F.struct(
        F.when(alternative == 0, v).alias("temperature_c"), F.when(alternative == 1, v).alias("temp_c"),
        F.when(alternative == 2, v).alias("temperature"), (F.col("event_id") % 100).alias("humidity"),
        F.when(F.col("event_id") % 2 == 0, F.lit("sunny")).alias("condition"),
    )
    nested = F.struct(F.struct(F.lit("cloudy").alias("text")).alias("condition"), v.alias("temp_c"), (F.col("event_id") % 100).alias("humidity_percent"))
    today = F.struct(F.when(alternative == 0, v - 5).alias("min_temperature_c"), F.when(alternative == 1, v - 5).alias("mintemp_c"))
    place = F.struct(F.concat(F.lit("L"), F.col("user_id")).alias("name"))
    plain = F.to_json(F.struct(place.alias("location"), current.alias("current"), today.alias("today")))
    other = F.to_json(F.struct(place.alias("location"), nested.alias("current"), today.alias("today")))
    raw = F.when(F.col("event_id") % 2 == 0, plain).otherwise(other)
    return w.events.select("event_id", weather.normalized_record(raw).alias("r")).select(
        "event_id", "r.location.name", "r.current.temperature_c", "r.current.humidity_percent", "r.current.condition",
        F.col("r.today.min_temperature_c").alias("lowest"),
    )


@query(
    "jn03_observation_trends",
    "SELECT event_id, o.country, temperature_c, AverageTemperature, TemperatureChange FROM observations o LEFT JOIN country_trends t ON lower(o.country) = lower(t.Country)",
)
def _(w):
    joined = compare.with_country_trends(w.observations, "country", w.ready_countries)
    return joined.select("event_id", "country", "temperature_c", "AverageTemperature", "TemperatureChange")


@query(
    "jn12_against_history",
    f"""SELECT event_id, o.country, temperature_c, AverageTemperature AS historical_avg, {r('temperature_c - AverageTemperature', 3)} AS difference
    FROM observations o LEFT JOIN country_trends t ON lower(o.country) = lower(t.Country)""",
)
def _(w):
    countries = w.ready_countries
    return compare.against_history(w.observations, "country", "temperature_c", countries).drop("ts")


@query("sc15_number_parse", f"SELECT event_id, {number('x')} AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS x FROM events)")
def _(w):
    text = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "n/a").otherwise(F.col("value").cast("string"))
    return w.events.select("event_id", parse_number(text).alias("v"))


PERIOD = """CASE event_id % 4 WHEN 0 THEN '2024-0' || (1 + event_id % 9) || '-1' || (event_id % 10)
  WHEN 1 THEN (2000 + event_id % 25) || '-0' || (1 + event_id % 9) WHEN 2 THEN CAST(2000 + event_id % 25 AS VARCHAR(4)) ELSE 'soon' END"""


@query(
    "sc14_period_bounds",
    f""", p AS (SELECT event_id, {PERIOD} AS period FROM events), d AS (
      SELECT *, CASE length(period) WHEN 10 THEN 'day' WHEN 7 THEN 'month' WHEN 4 THEN CASE WHEN period <> 'soon' THEN 'year' END END AS mode FROM p),
    b AS (SELECT *, CAST(CASE mode WHEN 'day' THEN period WHEN 'month' THEN period || '-01' WHEN 'year' THEN period || '-01-01' END AS DATE) AS s FROM d)
    SELECT event_id, period, mode, strftime(s, '%Y-%m-%d') AS start_date, strftime(CASE mode WHEN 'day' THEN s WHEN 'month' THEN least(last_day(s), DATE '{AS_OF}')
      WHEN 'year' THEN least(CAST(s + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE), DATE '{AS_OF}') END, '%Y-%m-%d') AS end_date,
      CASE mode WHEN 'month' THEN strftime(s, '%B %Y') WHEN 'day' THEN period WHEN 'year' THEN period END AS label FROM b""",
)
def _(w):
    as_of = F.lit(AS_OF).cast("date")
    periods = w.events.select("event_id", F.expr(PERIOD).alias("period"))
    return periods.select("event_id", "period", period_bounds(F.col("period"), as_of).alias("b")).select("event_id", "period", "b.*")
