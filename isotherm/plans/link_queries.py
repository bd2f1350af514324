"""Linking texts to names, picking rows, comparing, and the composite reports."""

from pyspark.sql import functions as F

from isotherm.functions.lookups import COMPARE_ALIASES, COUNTRY_OF_CITY, FACT_ALIASES, STATION_ALIASES
from isotherm.functions.numbers import round_to
from isotherm.functions.questions import LATEST_YEAR_WORDS, TERM_STOP_WORDS
from isotherm.operators import compare, linking, ranking, selection, trends
from isotherm.plans import oracle as o
from isotherm.plans import reports
from isotherm.plans.catalog import query
from isotherm.plans.linked import linked_sql
from isotherm.plans.panel_queries import COUNTRY_TIES, REGION_TIES

NORM = f", nt AS (SELECT qid, ' ' || {o.norm('text')} || ' ' AS n FROM texts)"
MENTIONS = NORM + """, m AS (SELECT qid, kind, name FROM nt JOIN names ON contains(n, ' ' || phrase || ' '))"""
_ALIAS = ", ".join(f"('{a}', '{c}')" for a, c in COMPARE_ALIASES.items())
ALIASED = MENTIONS + f""", alias(a, full_name) AS (VALUES {_ALIAS}),
am AS (SELECT qid, kind, name FROM m UNION
  SELECT qid, kind, name FROM nt JOIN alias ON contains(n, ' ' || a || ' ') JOIN names ON phrase = full_name)"""


@query("so01_place_names", "SELECT Country AS name FROM means UNION SELECT Region FROM means")
def _(w):
    means, countries, regions = w.ready_means, w.ready_countries, w.ready_regions
    return selection.place_names(
        (countries, "Country"), (countries, "Region"), (regions, "Region"), (means, "Country"), (means, "Region")
    )


@query("jn06_entity_link", MENTIONS + " SELECT * FROM m")
def _(w):
    return linking.mentions(w.texts, "qid", "text", w.names)


@query("jn08_alias_link", ALIASED + " SELECT * FROM am")
def _(w):
    return linking.mentions(w.texts, "qid", "text", w.names, COMPARE_ALIASES).distinct()


FUZZY = """, tok AS (SELECT qid, list_filter(string_split(trim(n), ' '), lambda x: x <> '') AS t FROM nt),
pos AS (SELECT qid, t, unnest(generate_series(1, len(t))) AS i FROM tok),
two AS (SELECT qid, array_to_string(t[i:i + 1], ' ') AS phrase, 2 AS k FROM pos WHERE i < len(t)),
nw AS (SELECT kind, name, phrase AS np, len(string_split(phrase, ' ')) AS k FROM names),
pairs AS (SELECT d.phrase, kind, name, 1 - levenshtein(d.phrase, np) / greatest(length(d.phrase), length(np)) AS similarity
  FROM (SELECT DISTINCT phrase FROM two) d JOIN nw ON k = 2 AND length(d.phrase) BETWEEN length(np) - 4 AND length(np) + 4),
hits AS (SELECT qid, kind, name, max(similarity) AS similarity FROM two JOIN pairs USING (phrase) WHERE similarity >= 0.82 GROUP BY 1, 2, 3)"""


@query(
    "jn07_fuzzy_link",
    NORM + FUZZY + f" SELECT qid, kind, name, {o.r('similarity', 6)} AS similarity FROM hits",
)
def _(w):
    hits = linking.fuzzy_mentions(w.texts, "qid", "text", w.names, 0.82, measure="levenshtein")
    return hits.withColumn("similarity", round_to(F.col("similarity"), 6))


RATIO_HITS = f""" SELECT qid, kind, name, {o.r('max(similarity)', 6)} AS similarity FROM nq JOIN win USING (n) JOIN sm USING (phrase) JOIN nw USING (np) GROUP BY qid, kind, name"""


@query("jn07_fuzzy_ratio", linked_sql(0.88, source="texts", measure="ratio") + RATIO_HITS)
def _(w):
    hits = linking.fuzzy_mentions(w.texts, "qid", "text", w.names, 0.88)
    return hits.withColumn("similarity", round_to(F.col("similarity"), 6))


@query("jn07_fuzzy_ratio_any_width", linked_sql(0.82, exact_single=False, source="texts", measure="ratio") + RATIO_HITS)
def _(w):
    hits = linking.fuzzy_mentions(w.texts, "qid", "text", w.names, 0.82, exact_single=False)
    return hits.withColumn("similarity", round_to(F.col("similarity"), 6))


@query(
    "flt10_targets_region",
    MENTIONS + """ SELECT t.qid, contains(lower(text), 'region') OR r.qid IS NOT NULL AS targets_region
    FROM texts t LEFT JOIN (SELECT DISTINCT qid FROM m WHERE kind = 'Region') r ON t.qid = r.qid""",
)
def _(w):
    regions = linking.mentions(w.texts, "qid", "text", w.names.where("kind = 'Region'"))
    return selection.question_targets_region(w.texts, "qid", "text", regions)


NAMES_PLACE_SQL = " SELECT q.qid, k.qid IS NOT NULL AS names_place FROM texts q LEFT JOIN (SELECT DISTINCT qid FROM lk) k ON q.qid = k.qid"


@query("flt10_names_place", linked_sql(0.88, source="texts", measure="ratio") + NAMES_PLACE_SQL)
def _(w):
    return linking.names_place(w.texts, "qid", "text", w.names)


TERMS_SQL = f""", tm AS (SELECT qid, unnest(list_distinct(list_filter(string_split({o.norm('text')}, ' '),
      lambda x: length(x) > 2 AND x NOT IN ({o.quoted(TERM_STOP_WORDS)})))) AS term FROM texts)"""


@query(
    "flt10_names_place_by_edits",
    linked_sql(0.88, source="texts") + NAMES_PLACE_SQL,
)
def _(w):
    return linking.names_place(w.texts, "qid", "text", w.names, measure="levenshtein")


def picked_sql(n: int, measure: str) -> str:
    return linked_sql(0.88, source="texts", measure=measure) + TERMS_SQL + f""", ph AS (
      SELECT qid, kind, name, CASE kind WHEN 'Country' THEN 1 ELSE 2 END AS phase FROM lk UNION
      SELECT qid, kind, name, 3 FROM tm JOIN names ON contains(lower(name), term)),
    ch AS (SELECT * FROM ph QUALIFY phase = min(phase) OVER (PARTITION BY qid)),
    hit AS (SELECT DISTINCT qid, phase, t.* FROM ch JOIN country_trends t ON (kind = 'Country' AND t.Country = name) OR (kind = 'Region' AND t.Region = name)),
    al2 AS (SELECT q.qid, 4 AS phase, t.* FROM texts q, country_trends t WHERE q.qid NOT IN (SELECT qid FROM ph)),
    un AS (SELECT * FROM hit UNION ALL SELECT * FROM al2)
    SELECT qid, phase, row_number() OVER (PARTITION BY qid ORDER BY {COUNTRY_TIES}) AS row_no, Country, Region FROM un
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {COUNTRY_TIES}) <= {n}"""


@query("flt09_pick_rows", picked_sql(20, "ratio"))
def _(w):
    picked = linking.pick_rows(w.texts, "qid", "text", w.ready_countries, w.names, trends.country_order())
    return picked.select("qid", "phase", "row_no", "Country", "Region")


@query("flt09_pick_rows_by_edits", picked_sql(20, "levenshtein"))
def _(w):
    picked = linking.pick_rows(
        w.texts, "qid", "text", w.ready_countries, w.names, trends.country_order(), 20, "levenshtein"
    )
    return picked.select("qid", "phase", "row_no", "Country", "Region")


def first_sql(kind: str, table: str, order: str, n: int, measure: str) -> str:
    return linked_sql(0.82, exact_single=False, source="texts", measure=measure) + f""", hd AS (SELECT {kind} FROM {table} ORDER BY {order} LIMIT {n})
    SELECT qid, true AS matched, {kind} FROM lk JOIN {table} ON kind = '{kind}' AND name = {kind}
    UNION ALL SELECT qid, false, {kind} FROM texts, hd WHERE qid NOT IN (SELECT qid FROM lk WHERE kind = '{kind}')"""


@query("flt09_matched_or_first", first_sql("Country", "country_trends", COUNTRY_TIES, 10, "ratio"))
def _(w):
    rows = linking.matched_or_first(w.texts, "qid", "text", w.ready_countries, "Country", w.names, trends.country_order(), 10)
    return rows.select("qid", "matched", "Country")


@query("flt09_matched_or_first_region", first_sql("Region", "regional_trends", REGION_TIES, 6, "ratio"))
def _(w):
    rows = linking.matched_or_first(w.texts, "qid", "text", w.ready_regions, "Region", w.names, trends.region_order(), 6)
    return rows.select("qid", "matched", "Region")


@query(
    "flt09_search_terms",
    f""", t AS (SELECT qid, unnest(list_distinct(list_filter(string_split({o.norm('text')}, ' '),
      lambda x: length(x) > 2 AND x NOT IN ({o.quoted(TERM_STOP_WORDS)})))) AS term FROM texts)
    SELECT DISTINCT qid, name FROM t JOIN (SELECT DISTINCT name FROM names) n ON contains(lower(name), term)""",
)
def _(w):
    from isotherm.functions.questions import search_terms

    terms = w.texts.select("qid", F.explode_outer(search_terms(F.col("text"))).alias("part"))
    parts = linking.substrings(w.names.select("name").distinct(), "name", 3)
    return terms.join(parts, "part").select("qid", "name").distinct()


_YEAR_ASKED = f"""coalesce(CAST(nullif(regexp_extract(lower(text), '{o.YEAR}', 1), '') AS INTEGER),
  CASE WHEN {o.any_of('lower(text)', LATEST_YEAR_WORDS)} THEN (SELECT max(Year) FROM means) END)"""


@query(
    "flt04_year_asked",
    f""", a AS (SELECT qid, {_YEAR_ASKED} AS Year FROM texts),
    g AS (SELECT Year, count(*) AS n_rows, {o.DEC_MEAN.format('AvgTemperature', 3)} AS GlobalAverage FROM means GROUP BY Year)
    SELECT qid, a.Year, coalesce(n_rows, 0) AS n_rows, GlobalAverage FROM a LEFT JOIN g ON a.Year = g.Year WHERE a.Year IS NOT NULL""",
)
def _(w):
    means = w.ready_means
    return selection.rows_of_year(w.texts, "qid", "text", means)


_RANK_LOW = o.any_of("lower(text)", linking.LOW_WORDS)
_RANK_ANY = o.any_of("lower(text)", linking.LOW_WORDS + linking.HIGH_WORDS)


@query(
    "flt04_yearly_rows",
    linked_sql(0.88, source="texts", measure="ratio") + TERMS_SQL + f""", yq AS (SELECT qid, {_YEAR_ASKED} AS y, {_RANK_LOW} AS low, {_RANK_ANY} AS ranked FROM texts),
    aq AS (SELECT qid, low, ranked, CASE WHEN y IN (SELECT Year FROM means) THEN y ELSE -1 END AS part FROM yq),
    sl AS (SELECT Year AS part, * FROM means UNION ALL SELECT -1, * FROM means),
    rk AS (SELECT *, true AS low, row_number() OVER (PARTITION BY part ORDER BY AvgTemperature, Country, Region, Year) AS row_no FROM sl
      UNION ALL SELECT *, false, row_number() OVER (PARTITION BY part ORDER BY AvgTemperature DESC, Country, Region, Year) FROM sl),
    pl AS (SELECT DISTINCT part, 'Country' AS kind, Country AS name FROM sl UNION SELECT DISTINCT part, 'Region', Region FROM sl),
    ph AS (SELECT h.* FROM (SELECT qid, kind, name, CASE kind WHEN 'Country' THEN 1 ELSE 2 END AS phase FROM lk UNION
      SELECT qid, kind, name, 3 FROM tm JOIN names ON contains(lower(name), term)) h JOIN aq ON aq.qid = h.qid AND NOT ranked JOIN pl ON pl.part = aq.part AND pl.kind = h.kind AND pl.name = h.name),
    ch AS (SELECT * FROM ph QUALIFY phase = min(phase) OVER (PARTITION BY qid)),
    hit AS (SELECT DISTINCT ch.qid, sl.* FROM ch JOIN aq ON aq.qid = ch.qid JOIN sl ON sl.part = aq.part AND ((kind = 'Country' AND sl.Country = name) OR (kind = 'Region' AND sl.Region = name))),
    hd AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY part ORDER BY Country, Year, Region) <= 20),
    un AS (SELECT * FROM hit UNION ALL SELECT aq.qid, hd.* FROM aq JOIN hd ON hd.part = aq.part WHERE NOT ranked AND aq.qid NOT IN (SELECT qid FROM ph)),
    nb AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY Country, Year, Region) AS row_no, Country, Region, Year, AvgTemperature FROM un)
    SELECT * FROM nb WHERE row_no <= 20 UNION ALL
    SELECT aq.qid, row_no, Country, Region, Year, AvgTemperature FROM aq JOIN rk ON rk.part = aq.part AND rk.low = aq.low WHERE ranked AND row_no <= 20""",
)
def _(w):
    return linking.yearly_rows(w.ready_means, w.texts, "qid", "text", w.names)


_STOP = o.quoted(linking.PLACE_STOP_WORDS)
_CITY = ", ".join(f"('{c}', '{n}')" for c, n in COUNTRY_OF_CITY.items())


@query(
    "jn09_keyword_rows",
    f""", city(c, n) AS (VALUES {_CITY}),
    tok AS (SELECT qid, list_filter(string_split({o.norm('text')}, ' '), lambda x: x <> '') AS t FROM texts),
    kept AS (SELECT qid, t, list_filter(t, lambda x: x NOT IN ({_STOP})) AS k FROM tok),
    kw AS (SELECT qid, unnest(CASE WHEN len(k) > 0 THEN k ELSE t END) AS w FROM kept),
    ex AS (SELECT qid, w FROM kw UNION ALL SELECT qid, n FROM kw JOIN city ON w = c),
    cnt AS (SELECT qid, w, count(*) AS times FROM ex GROUP BY qid, w),
    sc AS (SELECT qid, Country, CAST(sum(times) AS BIGINT) AS score FROM cnt JOIN (SELECT DISTINCT Country FROM means) c ON contains(lower(Country), w) GROUP BY qid, Country),
    best AS (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {COUNTRY_TIES}) AS row_no, Country FROM sc JOIN country_trends USING (Country)),
    head AS (SELECT 0 AS score, row_number() OVER (ORDER BY {COUNTRY_TIES}) AS row_no, Country FROM country_trends)
    SELECT qid, score, row_no, Country FROM best WHERE row_no <= 20
    UNION ALL SELECT q.qid, h.score, row_no, Country FROM texts q, head h WHERE row_no <= 10 AND q.qid NOT IN (SELECT qid FROM sc)""",
)
def _(w):
    countries = w.ready_countries
    rows = linking.keyword_rows(w.texts, "qid", "text", countries, "Country", trends.country_order())
    return rows.select("qid", "score", "row_no", "Country")


_STATION = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in STATION_ALIASES.items())
_PLACE_OF_USER = "CASE user_id % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'england' WHEN 2 THEN 'Saudi' WHEN 3 THEN 'an' WHEN 4 THEN 'South Korea' ELSE 'Viet Nam' END || CASE WHEN user_id % 5 = 0 THEN ' ' || user_id ELSE '' END"


@query(
    "jn10_match_countries",
    f""", pl AS (SELECT DISTINCT {_PLACE_OF_USER} AS place FROM events), nm AS (SELECT place, {o.norm('place')} AS n FROM pl),
    wt AS (SELECT place, CASE n {_STATION} ELSE n END AS wanted FROM nm), c AS (SELECT DISTINCT Country FROM means),
    sc AS (SELECT place, Country, CASE WHEN wanted = lower(Country) THEN 100 WHEN contains(lower(Country), wanted) THEN 50
      ELSE 10 * len(list_filter(string_split(wanted, ' '), lambda x: contains(lower(Country), x))) END AS score FROM wt, c)
    SELECT place, Country, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY place ORDER BY score DESC, Country) AS rank FROM sc WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, Country) <= 20""",
)
def _(w):
    countries = w.ready_countries
    places = w.events.select(F.expr(_PLACE_OF_USER.replace("|| user_id", "|| CAST(user_id AS STRING)")).alias("place"))
    return linking.match_countries(places, "place", countries)


@query(
    "jn04_countries_of_regions",
    "SELECT * FROM country_trends WHERE Region IN (SELECT Region FROM regional_trends WHERE RegionalTemperatureChange > 0) ORDER BY TemperatureChange DESC, Region, Country LIMIT 10",
)
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return selection.countries_of_regions(countries, regions.where("RegionalTemperatureChange > 0"), 10)


@query(
    "jn04_regions_of_countries",
    "SELECT * FROM regional_trends WHERE Region IN (SELECT Region FROM country_trends WHERE TemperatureChange < 0) ORDER BY Region LIMIT 10",
)
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return selection.regions_of_countries(regions, selection.cooling(countries), 10)


_DIFFS = ", ".join(f"{o.r(f'a.{c} - b.{c}', 3)} AS {n}" for n, c in compare.METRICS.items())


@query(
    "jn05_pair_differences",
    ALIASED + f""", x AS (SELECT qid, t.*, row_number() OVER (PARTITION BY qid ORDER BY {COUNTRY_TIES}) AS no FROM am JOIN country_trends t ON kind = 'Country' AND name = t.Country)
    SELECT a.qid, a.Country AS a, b.Country AS b, {_DIFFS} FROM x a JOIN x b ON a.qid = b.qid AND a.no < b.no""",
)
def _(w):
    countries = w.ready_countries
    named = linking.mentions(w.texts, "qid", "text", w.names, COMPARE_ALIASES).distinct().where("kind = 'Country'")
    return compare.pair_differences(named, "qid", countries, trends.country_order())


_LOW = o.any_of("q", ranking.ASCENDING_WORDS)
_HIGH = o.any_of("q", ranking.DESCENDING_WORDS)
_CHANGE = o.any_of("q", ranking.CHANGE_WORDS)


def _ranked_sql():
    parts = []
    for change, metric, rmetric in ((True, "TemperatureChange", "RegionalTemperatureChange"), (False, "AverageTemperature", "AverageRegionalTemperature")):
        for low in (True, False):
            way = "ASC" if low else "DESC"
            parts.append(f"SELECT {change} AS ch, {low} AS lo, 'countries' AS section, row_number() OVER (ORDER BY {metric} {way}, Country, Region) AS rank, Country AS entity, '{metric}' AS metric, {metric} AS value FROM country_trends")
            parts.append(f"SELECT {change}, {low}, 'regions', row_number() OVER (ORDER BY {rmetric} {way}, Region), Region, '{rmetric}', {rmetric} FROM regional_trends")
        parts.append(f"SELECT {change}, false, 'coolest', row_number() OVER (ORDER BY AverageTemperature, Country, Region), Country, 'AverageTemperature', AverageTemperature FROM country_trends")
    return " UNION ALL ".join(parts)


@query(
    "tk06_asked_rankings",
    f""", q AS (SELECT qid, lower(text) AS q FROM texts), a AS (
      SELECT qid, {_CHANGE} AS ch, CASE WHEN {_CHANGE} THEN {_LOW} AND NOT {_HIGH} ELSE {_LOW} END AS lo,
        NOT {_LOW} AND NOT {_HIGH} AS neutral, {o.any_of('q', ranking.REGION_WORDS)} AS regions_only, {o.top_n('q')} AS n FROM q),
    l AS ({_ranked_sql()})
    SELECT qid, section, CAST(rank AS INTEGER) AS rank, entity, metric, value FROM a JOIN l ON a.ch = l.ch AND a.lo = l.lo
    WHERE rank <= n AND (section = 'regions' OR (NOT regions_only AND (section = 'countries' OR neutral)))""",
)
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return ranking.answer_rankings(w.texts, "qid", "text", countries, regions)


def _long_sql(source, section, entity, metrics, key="qid, "):
    return " UNION ALL ".join(
        f"SELECT {key}'{section}' AS section, {entity} AS entity, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics
    )


def _ranked_section(section, entity, metric, source, order, n, where="TRUE"):
    return (
        f"SELECT '{section}' AS section, row_number() OVER (ORDER BY {order}) AS rank, {entity} AS entity, '{metric}' AS metric, "
        f"CAST({metric} AS DOUBLE) AS value FROM {source} WHERE {where} QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"
    )


def _facts_sql(n, year):
    mean = o.DEC_MEAN.format("AvgTemperature", 3)
    t, rg = "country_trends", "regional_trends"
    one = lambda section, source, metrics: " UNION ALL ".join(
        f"SELECT '{section}' AS section, 0 AS rank, 'all' AS entity, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in metrics.items()
    )
    parts = [
        one("year", f"(SELECT count(*) AS n, {mean} AS v FROM means WHERE Year = {year})", {"n_rows": "n", "GlobalAverage": o.r("v", 3)}),
        _ranked_section("year_hottest", "Country", "AvgTemperature", "means", "AvgTemperature DESC, Country, Region", n, f"Year = {year}"),
        _ranked_section("year_coldest", "Country", "AvgTemperature", "means", "AvgTemperature, Country, Region", n, f"Year = {year}"),
        one("metadata", "means", {"n_rows": "count(*)", "n_countries": "count(DISTINCT Country)", "n_regions": "count(DISTINCT Region)",
            "n_years": "count(DISTINCT Year)", "first_year": "min(Year)", "last_year": "max(Year)"}),
        one("statistics", f"(SELECT {mean} AS m, median(AvgTemperature) AS d, min(AvgTemperature) AS lo, max(AvgTemperature) AS hi, stddev_samp(AvgTemperature) AS s FROM means)",
            {"mean": o.r("m", 3), "median": o.r("d", 3), "min": o.r("lo", 3), "max": o.r("hi", 3), "std": o.r("s", 3), "range": o.r("hi - lo", 3)}),
        one("global", "(SELECT arg_min(v, Year) AS f, arg_max(v, Year) AS l, max(v) AS hi, min(v) AS lo FROM g)",
            {"first_average": o.r("f", 3), "latest_average": o.r("l", 3), "change": o.r("l - f", 3),
             "hottest_year": "(SELECT min(Year) FROM g WHERE v = hi)", "coldest_year": "(SELECT min(Year) FROM g WHERE v = lo)"}),
        f"SELECT 'series' AS section, 0 AS rank, CAST(Year AS VARCHAR) AS entity, 'GlobalAverage' AS metric, {o.r('v', 3)} AS value FROM g QUALIFY row_number() OVER (ORDER BY Year DESC) <= 12",
        _ranked_section("latest_hottest", "Country", "AvgTemperature", "means", "AvgTemperature DESC, Country, Region", 1, "Year = (SELECT max(Year) FROM means)"),
        _ranked_section("country_hottest", "Country", "AverageTemperature", t, "AverageTemperature DESC, Region, Country", n),
        _ranked_section("country_coolest", "Country", "AverageTemperature", t, "AverageTemperature, Region, Country", n),
        _ranked_section("country_fastest", "Country", "TemperatureChange", t, "TemperatureChange DESC, Region, Country", n),
        _ranked_section("country_cooling", "Country", "TemperatureChange", t, "TemperatureChange, Region, Country", n, "TemperatureChange < 0"),
        _ranked_section("country_most_stable", "Country", "VolatilityScore", t, "VolatilityScore, Region, Country", n),
        _ranked_section("region_hottest", "Region", "AverageRegionalTemperature", rg, "AverageRegionalTemperature DESC, Region", n),
        _ranked_section("region_fastest", "Region", "RegionalTemperatureChange", rg, "RegionalTemperatureChange DESC, Region", n),
    ]
    return f", g AS (SELECT Year, {mean} AS v FROM means GROUP BY Year) " + " UNION ALL ".join(f"({p})" for p in parts)


@query("rp02_dataset_facts", _facts_sql(8, 1998))
def _(w):
    return reports.dataset_facts(w.ready_means, w.ready_countries, w.ready_regions, n=8, year=1998)


def matched_sql(measure: str) -> str:
    return f"""{linked_sql(0.88, aliases=FACT_ALIASES, source="texts", measure=measure)},
    cr AS (SELECT qid, t.* FROM lk JOIN country_trends t ON kind = 'Country' AND name = t.Country),
    rr AS (SELECT qid, t.* FROM lk JOIN regional_trends t ON kind = 'Region' AND name = t.Region),
    no AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {COUNTRY_TIES}) AS no FROM cr),
    df AS (SELECT a.qid, a.Country || ' vs ' || b.Country AS entity, {_DIFFS} FROM no a JOIN no b ON a.qid = b.qid AND a.no < b.no WHERE b.no <= 4)
    {_long_sql('cr', 'country', 'Country', reports.COUNTRY_METRICS)} UNION ALL {_long_sql('df', 'difference', 'entity', list(compare.METRICS)[:3])}
    UNION ALL {_long_sql('rr', 'region', 'Region', reports.REGION_METRICS)}"""


@query("rp02_matched_facts", matched_sql("ratio"))
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return reports.matched_facts(w.texts, "qid", "text", w.names, countries, regions)


@query("rp02_matched_facts_by_edits", matched_sql("levenshtein"))
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return reports.matched_facts(w.texts, "qid", "text", w.names, countries, regions, measure="levenshtein")


@query(
    "rp03_comparison",
    f"""{ALIASED}, s AS (SELECT a.* FROM am a JOIN (SELECT qid, kind FROM am GROUP BY qid, kind HAVING count(*) >= 2) k ON a.qid = k.qid AND a.kind = k.kind),
    cr AS (SELECT qid, t.* FROM s JOIN country_trends t ON kind = 'Country' AND name = t.Country),
    rr AS (SELECT qid, t.* FROM s JOIN regional_trends t ON kind = 'Region' AND name = t.Region),
    no AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(Country) DESC, Country) AS no FROM cr),
    df AS (SELECT a.qid, a.Country || ' vs ' || b.Country AS entity, {_DIFFS} FROM no a JOIN no b ON a.qid = b.qid AND a.no < b.no)
    {_long_sql('cr', 'country', 'Country', reports.COUNTRY_METRICS)} UNION ALL {_long_sql('df', 'difference', 'entity', list(compare.METRICS))}
    UNION ALL {_long_sql('rr', 'region', 'Region', reports.REGION_METRICS)}""",
)
def _(w):
    countries, regions = w.ready_countries, w.ready_regions
    return reports.comparison(w.texts, "qid", "text", w.names, countries, regions)


@query(
    "rp04_place_profile",
    f""", o AS (SELECT event_id, lower(country) AS nm, temperature_c FROM observations),
    ct AS (SELECT event_id, t.* FROM o JOIN country_trends t ON nm = lower(t.Country)),
    rt AS (SELECT event_id, g.* FROM ct JOIN regional_trends g ON ct.Region = g.Region),
    ys AS (SELECT Country, Year, AvgTemperature FROM means QUALIFY row_number() OVER (PARTITION BY Country ORDER BY Year DESC, Region) <= 5)
    SELECT event_id, 'observation' AS section, nm AS entity, 'temperature_c' AS metric, temperature_c AS value FROM o UNION ALL
    {_long_sql('ct', 'country', 'Country', reports.COUNTRY_METRICS, 'event_id, ')} UNION ALL {_long_sql('rt', 'region', 'Region', reports.REGION_METRICS, 'event_id, ')}
    UNION ALL SELECT event_id, 'yearly', CAST(Year AS VARCHAR), 'AvgTemperature', AvgTemperature FROM o JOIN ys ON nm = lower(ys.Country)""",
)
def _(w):
    means, countries, regions = w.ready_means, w.ready_countries, w.ready_regions
    return reports.place_profile(w.observations, "event_id", "country", "temperature_c", means, countries, regions)
