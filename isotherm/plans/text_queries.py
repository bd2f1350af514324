"""Column functions over questions and whole texts, and the state of conversations."""

from pyspark.sql import functions as F

from isotherm.functions.distributed import spread
from isotherm.functions import facts, markup, numbers, questions, text
from isotherm.operators import conversation
from isotherm.plans import oracle as o
from isotherm.plans.catalog import query
from isotherm.plans.linked import linked_sql
from isotherm.plans.workload import AS_OF, pick_of
from isotherm.functions.lookups import PLACE_ALIASES

Q = ", q AS (SELECT qid, text, lower({0}) AS q, {0} AS masked FROM texts)".format(o.MASKED.format("text"))
PLACES = Q + f""", c AS (SELECT *, {o.cleaned_for_place('masked')} AS cleaned FROM q),
p AS (SELECT qid, text, q, {o.place_of('cleaned')} AS place, {o.historical_date('q')} AS date FROM c)"""
HAS_YEAR = f"regexp_matches(q, '{o.YEAR}')"
FOLLOWUP = f"""CASE WHEN {o.any_of('q', questions.FOLLOWUP_NEW_YEAR)} OR place IS NOT NULL OR {HAS_YEAR} THEN false
  WHEN regexp_matches(q, '\\b(last|past|previous)\\s+[0-9]+\\s+years?\\b') THEN true
  WHEN {o.any_of('q', questions.FOLLOWUP_FRESH)} THEN false ELSE {o.any_of('q', questions.FOLLOWUP_WORDS)} END"""


def as_of():
    return F.lit(AS_OF).cast("date")


def over_texts(w, **columns):
    return w.texts.select("qid", *[c.alias(n) for n, c in columns.items()])


@query("sc01_normalize", f"SELECT qid, {o.norm('text')} AS norm FROM texts")
def _(w):
    return over_texts(w, norm=text.normalize(F.col("text")))


@query(
    "sc02_intent",
    Q + f""" SELECT qid, CASE WHEN trim(q) = '' THEN 'unsupported' WHEN {HAS_YEAR} THEN 'climate'
      WHEN {o.any_of('q', questions.INTENT_WEATHER)} AND {o.any_of('q', questions.INTENT_CLIMATE)} AND contains(q, 'compare') THEN 'comparison'
      WHEN {o.any_of('q', questions.INTENT_CLIMATE)} THEN 'climate' WHEN {o.any_of('q', questions.INTENT_WEATHER)} THEN 'weather'
      ELSE 'unsupported' END AS intent FROM q""",
)
def _(w):
    return over_texts(w, intent=questions.intent(F.col("text")))


@query(
    "sc03_question_type",
    Q + " SELECT qid, CASE " + " ".join(f"WHEN {o.any_of('q', ws)} THEN '{n}'" for n, ws in questions.TYPE_WORDS.items()) + " ELSE 'general' END AS kind FROM q",
)
def _(w):
    return over_texts(w, kind=questions.question_type(F.col("text")))


@query("sc04_top_n", Q + f" SELECT qid, {o.top_n('q')} AS n FROM q")
def _(w):
    return over_texts(w, n=questions.top_n(F.col("text")))


@query(
    "sc05_requested_year",
    Q + f""" SELECT qid, coalesce(CAST(nullif(regexp_extract(q, '{o.YEAR}', 1), '') AS INTEGER),
      CASE WHEN {o.any_of('q', questions.LATEST_YEAR_WORDS)} THEN (SELECT max(Year) FROM means) END, -1) AS year FROM q""",
)
def _(w):
    latest = w.panel.select(F.max("Year")).scalar()
    return over_texts(w, year=F.coalesce(questions.requested_year(F.col("text"), latest), F.lit(-1)))


@query("sc06_historical_date", PLACES + " SELECT qid, date FROM p")
def _(w):
    return text.with_date(w.texts, "text", as_of()).select("qid", "date")


@query("sc07_place_phrase", PLACES + " SELECT qid, place FROM p")
def _(w):
    return text.with_place(w.texts, "text").select("qid", "place")


@query(
    "sc08_weather_flags",
    PLACES + f""" SELECT qid, {o.any_of('q', questions.WEATHER_LIKE + [' in ', ' at ', ' of '])} AS weather_like,
      date IS NOT NULL AND {o.any_of('q', questions.WEATHER_PAST)} AS past_weather, place, date FROM p""",
)
def _(w):
    q = F.col("q")
    return text.parse_texts(w.texts, "text", as_of()).select(
        "qid", questions.looks_like_weather(q).alias("weather_like"),
        questions.asks_past_weather(q, F.col("date")).alias("past_weather"), "place", "date",
    )


@query("sc09_followup", PLACES + f" SELECT qid, {FOLLOWUP} AS followup FROM p")
def _(w):
    parsed = text.parse_texts(w.texts, "text", as_of())
    return parsed.select("qid", questions.is_followup(F.col("q"), F.col("place")).alias("followup"))


NAMED = linked_sql(0.88, source="texts", measure="ratio") + ", named AS (SELECT DISTINCT qid FROM lk)"
FIXED = f"""CASE WHEN place IS NOT NULL AND ((date IS NOT NULL AND {o.any_of('q', questions.WEATHER_PAST)})
    OR ({o.any_of('q', questions.ROUTE_PLACE_WEATHER)} AND {HAS_YEAR})) THEN 'historical_weather'
  WHEN {o.any_of('q', questions.ROUTE_TIME)} OR ({HAS_YEAR} AND NOT (place IS NOT NULL AND {o.any_of('q', questions.ROUTE_PLACE_WEATHER)})) THEN 'climate' END"""
LIVE, TABLE = o.any_of("q", questions.ROUTE_LIVE), o.any_of("q", questions.ROUTE_TABLE)
KEYWORD = f"""CASE WHEN {o.any_of('q', questions.ROUTE_HYBRID)} OR ({LIVE} AND {o.any_of('q', questions.ROUTE_HYBRID_TABLE)}) THEN 'hybrid'
  WHEN {LIVE} AND NOT {TABLE} THEN 'weather' WHEN {TABLE} OR names_place THEN 'climate'
  WHEN {LIVE} OR ({o.any_of('q', questions.ROUTE_TEMPERATURE)} AND place IS NOT NULL) THEN 'weather'
  WHEN {o.any_of('q', questions.ROUTE_LAST_CHANCE)} THEN 'climate' ELSE 'out_of_scope' END"""
ROUTES = PLACES + NAMED + f""", f AS (SELECT p.*, n.qid IS NOT NULL AS names_place FROM p LEFT JOIN named n ON p.qid = n.qid),
routes AS (SELECT qid, place, {FIXED} AS fixed, {FOLLOWUP} AS follow, {KEYWORD} AS keyword FROM f)"""


@query(
    "sc10_answer_route",
    ROUTES + " SELECT qid, coalesce(fixed, CASE WHEN follow THEN 'weather' END, keyword) AS route FROM routes",
)
def _(w):
    routed = conversation.routed_texts(w.texts, "qid", "text", w.names, as_of())
    return routed.select("qid", questions.answer_route(F.lit("weather")).alias("route"))


@query(
    "wn09_carried_source",
    ROUTES + """, t AS (SELECT conv_id, turn, coalesce(fixed, '') <> '' AS has_fixed, fixed, fixed IS NULL AND follow AS follow, keyword
      FROM routes r JOIN questions s ON r.qid = s.qid),
    src AS (SELECT *, CASE coalesce(fixed, keyword) WHEN 'historical_weather' THEN 'weather' WHEN 'out_of_scope' THEN NULL ELSE coalesce(fixed, keyword) END AS source FROM t),
    a AS (SELECT *, last_value(CASE WHEN NOT follow THEN source END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM src),
    b AS (SELECT *, first_value(CASE WHEN follow AND anchor IS NULL THEN source END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead FROM a),
    s AS (SELECT *, coalesce(anchor, lead) AS state FROM b)
    SELECT conv_id, turn, follow AS followup, state AS last_source,
      CASE WHEN follow THEN coalesce(CASE state WHEN 'hybrid' THEN 'climate' ELSE state END, keyword) ELSE coalesce(fixed, keyword) END AS route FROM s""",
)
def _(w):
    routed = conversation.routed_texts(w.questions, "qid", "text", w.names, as_of())
    return conversation.route_turns(routed).select("conv_id", "turn", "followup", "last_source", "route")


_CITY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACE_ALIASES.items())


@query(
    "sc11_place_name",
    f"""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'New York' WHEN 'MACHINERY' THEN 'United Kingdom'
      ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Town' END AS place FROM customer""",
)
def _(w):
    segment = F.col("c_mktsegment")
    raw = F.when(segment == "BUILDING", " nyc").when(segment == "MACHINERY", "UK").otherwise(
        F.concat(segment, F.lit(" tOWN "))
    )
    return w.table("customer").select("c_custkey", text.place_name(raw).alias("place"))


@query(
    "sc12_search_terms",
    f""", t AS (SELECT qid, unnest(list_distinct(list_filter(string_split({o.norm('text')}, ' '),
      lambda x: length(x) > 2 AND x NOT IN ({o.quoted(questions.TERM_STOP_WORDS)})))) AS term FROM texts)
    SELECT qid, count(*) AS n_terms, string_agg(term, ' ' ORDER BY term) AS terms FROM t GROUP BY qid""",
)
def _(w):
    terms = over_texts(w, terms=questions.search_terms(F.col("text"))).where(F.size("terms") > 0)
    return terms.select(
        "qid", F.size("terms").cast("bigint").alias("n_terms"), F.array_join(F.array_sort("terms"), " ").alias("terms")
    )


@query(
    "sc13_number_format",
    f"SELECT event_id, format('{{:.2f}} C', {o.r('value', 2)}) AS v2, format('{{:.0f}}', {o.r('value', 0)}) AS v0, "
    "CASE event_id % 3 WHEN 0 THEN '5 km/h' WHEN 1 THEN '7 km/h' ELSE '-' END AS with_unit FROM events",
)
def _(w):
    raw = F.when(F.col("event_id") % 3 == 0, "5 km/h").when(F.col("event_id") % 3 == 1, " 7").otherwise("")
    return w.events.select(
        "event_id", numbers.fmt_number(F.col("value"), " C", 2).alias("v2"), numbers.fmt_number(F.col("value"), "", 0).alias("v0"),
        numbers.append_unit(raw, " km/h").alias("with_unit"),
    )


@query(
    "sc16_value_class",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END "
    "WHEN event_id % 3 = 1 THEN CASE WHEN value > 25 THEN 'hot' WHEN value < 5 THEN 'cold' ELSE 'neu' END ELSE 'neu' END AS class FROM events",
)
def _(w):
    sign = F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")
    shown = F.concat(F.col("value").cast("string"), F.lit("°C"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(sign, shown, F.lit(" warming Trend"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit(" "), shown)
    ).otherwise("n/a")
    return w.events.select("event_id", numbers.value_class(raw).alias("class"))


# Lines of the given documents: each text is cut, and every third line is marked up.
LABEL = pick_of("doc_id % 8", ["Temperature", "Feels Like", "Condition", "Humidity", "Location", "Today Min", "Today Max", "Rainfall"])
MARKED = f"""array_join(transform(split(text, '\\n'), (l, i) -> CASE (i + doc_id) % 9 WHEN 0 THEN '## ' || l WHEN 1 THEN '- ' || l
  WHEN 2 THEN '| ' || l || ' |' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '3) ' || l ELSE '|---|:-:|' END WHEN 4 THEN '**' || {LABEL} || '**: ' || length(l) WHEN 5 THEN 'Wind - ' || doc_id || ' km/h'
  ELSE l END), '\\n')"""
SQL_LINES = f""", raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
marked AS (SELECT doc_id, line_no, trim(CASE (line_no - 1 + doc_id) % 9 WHEN 0 THEN '## ' || l WHEN 1 THEN '- ' || l WHEN 2 THEN '| ' || l || ' |'
  WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '3) ' || l ELSE '|---|:-:|' END WHEN 4 THEN '**' || {LABEL} || '**: ' || length(l) WHEN 5 THEN 'Wind - ' || doc_id || ' km/h' ELSE l END, ' ' || chr(9) || chr(13)) AS line FROM raw),
lv AS (SELECT *, trim(regexp_extract(line, '^(?:\\*\\*)?([^:*]+?)(?:\\*\\*)?\\s*[:\\-]\\s*(.+?)$', 1)) AS label,
  trim(regexp_extract(line, '^(?:\\*\\*)?([^:*]+?)(?:\\*\\*)?\\s*[:\\-]\\s*(.+?)$', 2)) AS value FROM marked),
typed AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN starts_with(line, '##') THEN 'heading' WHEN regexp_matches(line, '^[|][|\\s:-]*$') THEN 'rule' WHEN starts_with(line, '|') THEN 'table'
  WHEN regexp_matches(line, '^[-•*]\\s+') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]+[.)]\\s+') THEN 'numbered'
  WHEN label <> '' AND value <> '' THEN 'label_value' ELSE 'prose' END AS line_type FROM lv)"""


def marked(w):
    return spread(w.table("documents").select("doc_id", "text")).select("doc_id", F.expr(MARKED).alias("text"))


@query("sc17_label_values", SQL_LINES + " SELECT doc_id, line_no - 1 AS line_no, label, value FROM typed WHERE label <> '' AND value <> ''")
def _(w):
    return markup.label_values(marked(w), "doc_id", "text")


@query(
    "sc17_weather_fields",
    SQL_LINES + """, f AS (SELECT doc_id, line_no, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS k, value FROM typed WHERE label <> '' AND value <> ''),
    fl(k, field) AS (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in markup.WEATHER_LABELS.items()) + """),
    last AS (SELECT doc_id, field, arg_max(value, line_no) AS v FROM f JOIN fl USING (k) GROUP BY 1, 2)
    SELECT doc_id, coalesce(max(CASE WHEN field = 'loc' THEN v END), 'Weather') AS loc, """ + ", ".join(
        f"coalesce(max(CASE WHEN field = '{f}' THEN v{unit} END), '-') AS {f}"
        for f, unit in {"temp": " || ' C'", "feels": " || ' C'", "cond": "", "hum": "", "wind": "", "mn": " || ' C'", "mx": " || ' C'", "rain": " || ' mm'"}.items()
    ) + " FROM last GROUP BY doc_id HAVING count(CASE WHEN field <> 'loc' THEN 1 END) > 0",
)
def _(w):
    return markup.weather_fields(marked(w), "doc_id", "text")


@query("sc18_line_types", SQL_LINES + " SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line_type FROM typed")
def _(w):
    return markup.typed_lines(marked(w), "doc_id", "text").drop("line")


@query(
    "sc18_blocks",
    SQL_LINES + """, ty AS (SELECT doc_id, line_no, line_type AS own, CASE line_type WHEN 'rule' THEN 'table' ELSE line_type END AS line_type FROM typed),
    s AS (SELECT *, CASE WHEN line_type = lag(line_type) OVER w THEN 0 ELSE 1 END AS is_start FROM ty WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    b AS (SELECT *, CAST(sum(is_start) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block_no FROM s)
    SELECT doc_id, block_no, line_type, min(line_no) AS first_line, count(CASE WHEN own <> 'rule' THEN 1 END) AS n_lines FROM b GROUP BY doc_id, block_no, line_type HAVING count(CASE WHEN own <> 'rule' THEN 1 END) > 0""",
)
def _(w):
    return markup.blocks(marked(w), "doc_id", "text")


_F = lambda c, n=2, unit=" C": f"format('{{:.{n}f}}', {o.r(c, n)}) || '{unit}'"


@query(
    "sc19_country_sentences",
    f"""SELECT Country, Region, 'For ' || Country || ' in ' || Region || ', the latest temperature in the CSV is ' || {_F('LatestTemperature')}
      || '. The dataset shows a total warming of ' || {_F('TemperatureChange')} || ', with a trend of ' || {_F('WarmingTrendPerYear', 4, ' C/year')}
      || '. Its average temperature across the dataset period is ' || {_F('AverageTemperature')} || '. The hottest recorded year is ' || HottestYear
      || ', at ' || {_F('HottestTemperature')} || '. The volatility score is ' || {_F('VolatilityScore', 3, '')} || '.' AS summary FROM country_trends""",
)
def _(w):
    return w.country_trends.select("Country", "Region", facts.country_summary().alias("summary"))


@query(
    "sc19_yearly_sentences",
    f"""SELECT Country, Year, 'For ' || Country || ' in ' || Region || ', the CSV yearly temperature for ' || Year || ' is ' || {_F('AvgTemperature')}
      || '. The year-to-year temperature change is ' || {_F('TempChange')} || '. The total change from the dataset baseline is ' || {_F('TotalTempChange')}
      || '. The matching regional average temperature is ' || {_F('RegionalAverageTemperature')} || '.' AS summary FROM yearly""",
)
def _(w):
    return w.yearly.select("Country", "Year", facts.yearly_summary().alias("summary"))


@query(
    "sc19_regional_sentences",
    f"""SELECT Region, 'At the regional level, ' || Region || ' rose from ' || {_F('FirstRegionalTemperature')} || ' to ' || {_F('LatestRegionalTemperature')}
      || '. That is a regional change of ' || {_F('RegionalTemperatureChange')} || ', with a trend of ' || {_F('RegionalWarmingTrendPerYear', 4, ' C/year')}
      || '. The regional volatility score is ' || {_F('RegionalVolatilityScore', 3, '')} || '.' AS summary FROM regional_trends""",
)
def _(w):
    return w.regional_trends.select("Region", facts.regional_summary().alias("summary"))


@query(
    "sc19_country_against_region",
    f"""SELECT Country, c.Region, 'Compared with ' || c.Region || ', ' || Country || '''s total warming is ' || {_F('TemperatureChange')} || ', while the regional change is '
      || {_F('RegionalTemperatureChange')} || '. Per-year trends: ' || {_F('WarmingTrendPerYear', 4, ' C/year')} || ' for ' || Country || ', '
      || {_F('RegionalWarmingTrendPerYear', 4, ' C/year')} || ' for ' || c.Region || '.' AS summary FROM country_trends c JOIN regional_trends g ON c.Region = g.Region""",
)
def _(w):
    rows = w.country_trends.join(w.regional_trends.drop("FirstYear", "LatestYear"), "Region")
    return rows.select("Country", "Region", facts.country_against_region().alias("summary"))


@query(
    "sc19_fact_lines",
    "SELECT Country, Year, 'Country: ' || Country || '; Region: ' || Region || '; Year: ' || Year || coalesce('; AvgTemperature: ' || "
    "CASE WHEN Year <> 1997 THEN format('{:.1f}', floor(AvgTemperature)) END, '') AS facts FROM means",
)
def _(w):
    shown = F.format_string("%.1f", F.floor("AvgTemperature").cast("double"))
    rows = w.means.withColumn("AvgTemperature", F.when(F.col("Year") != 1997, shown))
    return rows.select("Country", "Year", facts.fact_line(rows).alias("facts"))


@query(
    "wn08_recent_turns",
    "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4",
)
def _(w):
    return conversation.recent_turns(w.table("conversations"), 4)


@query(
    "wn08_history_text",
    """, l AS (SELECT conv_id, turn, upper(role) || ': ' || trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS line, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8)
    SELECT conv_id, coalesce(string_agg(CASE WHEN t <> '' THEN line END, chr(10) ORDER BY turn), 'No previous conversation.') AS history FROM l GROUP BY conv_id""",
)
def _(w):
    return conversation.history_text(w.table("conversations"), 8)
