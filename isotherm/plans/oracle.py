"""ANSI-SQL texts of the derived tables, and SQL fragments the oracles share."""

from __future__ import annotations

from isotherm.functions.lookups import MONTHS, REGION_OF_COUNTRY, WEATHER_CODES
from isotherm.functions.text import NOT_A_PLACE, PLACE_END
from isotherm.plans.workload import AS_OF, COUNTRY, DIRTY, EVENT_CODE, QUESTION, QUESTION_PARTS, TURN_ID


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def r(x: str, digits: int) -> str:
    """Round the exact binary value, ties to even."""
    k = f"CAST({10**digits} AS DOUBLE)"
    p = f"(({x}) * {k})"
    c = f"(({x}) * CAST(134217729 AS DOUBLE))"
    hi = f"({c} - ({c} - ({x})))"
    err = f"(({hi} * {k} - {p}) + (({x}) - {hi}) * {k})"
    return (
        f"(CASE WHEN {p} - floor({p}) = 0.5 AND {err} < 0 THEN floor({p}) "
        f"WHEN {p} - floor({p}) = 0.5 AND {err} > 0 THEN ceil({p}) ELSE round_even({p}, 0) END / {k})"
    )


def any_of(text: str, words) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def number(x: str) -> str:
    """A finite number or NULL."""
    t = f"trim({x})"
    v = f"TRY_CAST({t} AS DOUBLE)"
    ok = f"regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"
    return f"(CASE WHEN {ok} AND isfinite({v}) THEN {v} END)"


def trends(source: str, keys: str, v: str, digits: int) -> str:
    k = f"CAST({10**digits} AS DOUBLE)"
    whole = f"CAST(CAST({v} AS DECIMAL(28,{digits})) * {10**digits} AS HUGEINT)"
    top = f"(count(*) * sum(Year * {whole}) - sum(Year) * sum({whole}))"
    bottom = "(count(*) * sum(Year * Year) - sum(Year) * sum(Year))"
    return f"""
    SELECT {keys}, min(Year) AS y0, max(Year) AS y1, arg_min({v}, Year) AS f, arg_max({v}, Year) AS l,
      {DEC_MEAN.format(v, digits)} AS a, arg_max({v}, Year) - arg_min({v}, Year) AS c,
      CASE WHEN count(DISTINCT Year) < 2 THEN 0 ELSE CAST({top} AS DOUBLE) / (CAST({bottom} AS DOUBLE) * {k}) END AS s,
      CASE WHEN count(step) = 0 THEN 0 ELSE stddev_samp(step) END AS vol, max({v}) AS p
    FROM (SELECT *, {v} - lag({v}) OVER (PARTITION BY {keys} ORDER BY Year) AS step FROM {source})
    GROUP BY {keys}"""


DEC_MEAN = "CAST(sum(CAST({0} AS DECIMAL(28,{1}))) AS DOUBLE) / count({0})"

# (?U) has no counterpart in the oracle's regex engine, where \b is ASCII. Accented
# letters therefore become an underscore, which is a word character there too.
MASKED = (
    "regexp_replace({0}, '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}"
    "\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{02C1}}]', '_', 'g')"
)

MONTH_NAMES = "|".join(MONTHS)
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
MONTH_NO = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MONTHS.items()) + " END"


def _day(y: str, m: str, d: str) -> str:
    iso = f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    ok = f"{y} <> '' AND {y} <> '0000' AND CAST(try_strptime({iso}, '%Y-%m-%d') AS DATE) < DATE '{AS_OF}'"
    return f"CASE WHEN {ok} THEN {iso} END"


def _month(y: str, m: str) -> str:
    iso = f"{y} || '-' || {m}"
    ok = f"{y} <> '' AND {y} <> '0000' AND CAST(try_strptime({iso} || '-01', '%Y-%m-%d') AS DATE) < DATE '{AS_OF}'"
    return f"CASE WHEN {ok} THEN {iso} END"


def historical_date(q: str) -> str:
    """``q`` is a lower-cased, masked text."""
    g = lambda p, n: f"regexp_extract({q}, '{p}', {n})"
    mon = lambda x: MONTH_NO.format(x)
    p1 = rf"({MONTH_NAMES})\s+([0-9]{{1,2}})[,\s]+([0-9]{{4}})"
    p2 = rf"([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\s+([0-9]{{4}})"
    p3 = r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})"
    p4 = r"([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    p5 = rf"({MONTH_NAMES})\s+([0-9]{{4}})"
    p6 = rf"([0-9]{{4}})\s+({MONTH_NAMES})"
    year = f"coalesce(nullif({g(r'(?:in|during|for|of|year)\s+((?:19|20)[0-9]{2})\b', 1)}, ''), nullif({g(YEAR, 1)}, ''))"
    return f"""coalesce(
      {_day(g(p1, 3), mon(g(p1, 1)), g(p1, 2))}, {_day(g(p2, 3), mon(g(p2, 2)), g(p2, 1))},
      {_day(g(p3, 1), g(p3, 2), g(p3, 3))}, {_day(g(p4, 3), g(p4, 2), g(p4, 1))},
      {_month(g(p5, 2), mon(g(p5, 1)))}, {_month(g(p6, 1), mon(g(p6, 2)))},
      CASE WHEN CAST({year} AS INTEGER) <= {AS_OF[:4]} THEN {year} END)"""


def cleaned_for_place(x: str) -> str:
    t = f"regexp_replace({x}, '(?i)\\b({MONTH_NAMES})\\b', '', 'g')"
    t = f"regexp_replace({t}, '\\b(19|20)[0-9]{{2}}\\b', '', 'g')"
    t = f"regexp_replace({t}, '\\b[0-9]{{1,2}}(st|nd|rd|th)?\\b', '', 'g')"
    return squeeze(f"regexp_replace({t}, '(?i)\\bon\\b', '', 'g')")


def place_of(cleaned: str) -> str:
    phrase = rf"([A-Za-z][A-Za-z\s]{{1,40}}?)(?:\s+(?:{PLACE_END})|\?|$)"
    weather = "weather|temperature|temp|forecast|condition|conditions"
    parts = []
    for p in (
        rf"(?i)\bin\s+{phrase}", rf"(?i)\bat\s+{phrase}", rf"(?i)\bfor\s+{phrase}",
        rf"(?i)\b(?:{weather})\s+(?:in\s+|for\s+|at\s+|of\s+)?{phrase}",
    ):
        x = squeeze(f"regexp_extract({cleaned}, '{p}', 1)")
        parts.append(f"CASE WHEN length({x}) >= 2 AND lower({x}) NOT IN ({quoted(NOT_A_PLACE)}) THEN {x} END")
    return f"coalesce({', '.join(parts)})"


def top_n(q: str, default: int = 10) -> str:
    """``q`` is a lower-cased, masked text."""
    entity = "countries|regions|hottest|coolest|warmest|fastest|coldest|slowest"
    digits = ", ".join(
        f"nullif(regexp_extract({q}, '{p}', 1), '')"
        for p in (
            r"\btop[\s\-_]?([0-9]+)\b",
            rf"\b([0-9]+)\s+(?:{entity})\b",
            r"\b(?:show|give|list|find|get|fetch|display)\s+(?:me\s+)?([0-9]+)\b",
            r"\b([0-9]+)\b.*?\b(?:countries|regions|results|entries|rows|records)\b",
        )
    )
    return f"CAST(least(coalesce(TRY_CAST(coalesce({digits}) AS HUGEINT), {default}), 200) AS INTEGER)"


_CANON = ", ".join(f"('{c}', '{g}')" for c, g in REGION_OF_COUNTRY.items())
_PARTS = ", ".join(f"{e} AS {c}" for c, e in QUESTION_PARTS.items())
_DIRTY = ", ".join(f"{e} AS {c}" for c, e in DIRTY.items())
_MEAN2 = "round_even(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 100, 0) / 100"
_YEARLY_MEAN = "round_even(CAST(sum(AvgTemperature) AS DOUBLE) / count(AvgTemperature) * 1000, 0) / 1000"

BASE = f"""WITH RECURSIVE canon(Country, canon_region) AS (VALUES {_CANON}),
codes(code, code_text) AS (VALUES {', '.join(f"({k}, '{v}')" for k, v in WEATHER_CODES.items())}),
priced AS (
  SELECT o_orderkey, {COUNTRY} AS Country, r_name AS Region, CAST(year(o_orderdate) AS INTEGER) AS Year,
    CAST(o_totalprice AS DECIMAL(18,2)) AS AvgTemperature
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
panel AS (
  SELECT p.Country, coalesce(canon_region, p.Region) AS Region, Year, AvgTemperature
  FROM priced p LEFT JOIN canon c ON p.Country = c.Country),
dirty AS (
  SELECT o_orderkey, {_DIRTY}
  FROM (SELECT o_orderkey, Country, Region, CAST(Year AS VARCHAR) AS y, CAST(AvgTemperature AS VARCHAR) AS v FROM priced)),
means AS (
  SELECT Country, Region, Year, {_YEARLY_MEAN} AS AvgTemperature FROM panel GROUP BY Country, Region, Year),
regional AS (
  SELECT Region, Year, {DEC_MEAN.format('AvgTemperature', 3)} AS RegionalAverageTemperature FROM means GROUP BY Region, Year),
yearly AS (
  SELECT m.Country, m.Region, m.Year, m.AvgTemperature,
    coalesce(m.AvgTemperature - lag(m.AvgTemperature) OVER w, 0) AS TempChange,
    first_value(m.AvgTemperature) OVER w AS BaselineTemperature,
    m.AvgTemperature - first_value(m.AvgTemperature) OVER w AS TotalTempChange,
    g.RegionalAverageTemperature, g.RegionalTempChange
  FROM means m JOIN (
    SELECT *, coalesce(RegionalAverageTemperature - lag(RegionalAverageTemperature)
      OVER (PARTITION BY Region ORDER BY Year), 0) AS RegionalTempChange FROM regional) g
    ON m.Region = g.Region AND m.Year = g.Year
  WINDOW w AS (PARTITION BY m.Region, m.Country ORDER BY m.Year)),
country_raw AS ({trends('means', 'Region, Country', 'AvgTemperature', 3)}),
peaks AS (
  SELECT Region, Country, Year AS HottestYear FROM (
    SELECT *, row_number() OVER (PARTITION BY Region, Country ORDER BY AvgTemperature DESC, Year) AS rn FROM means) WHERE rn = 1),
country_trends AS (
  SELECT t.Region, t.Country, y0 AS FirstYear, y1 AS LatestYear, {r('f', 3)} AS FirstTemperature,
    {r('l', 3)} AS LatestTemperature, {r('a', 3)} AS AverageTemperature, {r('c', 3)} AS TemperatureChange,
    {r('s', 4)} AS WarmingTrendPerYear, {r('vol', 4)} AS VolatilityScore, HottestYear, {r('p', 3)} AS HottestTemperature
  FROM country_raw t JOIN peaks k ON t.Region = k.Region AND t.Country = k.Country),
regional_raw AS ({trends('regional', 'Region', 'RegionalAverageTemperature', 9)}),
regional_trends AS (
  SELECT Region, y0 AS FirstYear, y1 AS LatestYear, {r('f', 3)} AS FirstRegionalTemperature,
    {r('l', 3)} AS LatestRegionalTemperature, {r('a', 3)} AS AverageRegionalTemperature,
    {r('c', 3)} AS RegionalTemperatureChange, {r('s', 4)} AS RegionalWarmingTrendPerYear,
    {r('vol', 4)} AS RegionalVolatilityScore
  FROM regional_raw),
daily AS (
  SELECT 'L' || CAST(user_id AS VARCHAR) AS location, CAST(ts AS DATE) AS day, max(value) AS tmax, min(value) AS tmin,
    CASE WHEN count(*) % 4 <> 0 THEN {_MEAN2} END AS tmean,
    CAST(sum(CASE WHEN event_type IN ('view', 'error') THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS precipitation,
    CAST(sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS rain,
    max(CASE WHEN event_type = 'click' THEN value END) AS wind,
    CAST(min({EVENT_CODE}) AS INTEGER) AS code
  FROM events GROUP BY 1, 2),
questions AS (
  SELECT event_id AS qid, user_id AS conv_id, event_id AS turn, {QUESTION} AS text
  FROM (SELECT event_id, user_id, {_PARTS} FROM events)),
texts AS (
  SELECT qid, text FROM questions UNION ALL
  SELECT {TURN_ID} AS qid, text FROM conversations),
names AS (
  SELECT DISTINCT kind, name, {norm('name')} AS phrase FROM (
    SELECT 'Country' AS kind, Country AS name FROM means UNION ALL SELECT 'Region', Region FROM means)),
observations AS (
  SELECT event_id, ts, upper({QUESTION_PARTS['c1']}) AS country, value AS temperature_c FROM events)
"""


def _best_block(a: str, b: str) -> str:
    """The longest common block of two texts, the earliest in ``a``: a struct of its length and its negated start."""
    lengths = f"list_filter(range(1, length({a}) - i + 2), lambda k: contains({b}, substr({a}, i, k)))"
    return f"list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: list_transform({lengths}, lambda k: {{'k': k, 'ni': -i}}))))"


# CTE ``ratios(np, p, similarity)`` of the pairs in CTE ``cand(np, p)``: the share of characters in matching blocks.
# The longest common block splits both texts; the rests left and right of it are matched in the same way.
RATIOS = f"""seg AS (
    SELECT np, p, np AS a, p AS b, {_best_block('np', 'p')} AS m FROM cand
    UNION ALL
    SELECT np, p, x.a, x.b, {_best_block('x.a', 'x.b')} FROM (
      SELECT np, p, unnest([{{'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1)}}, {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS x FROM (
        SELECT *, position(substr(a, i, k) IN b) AS j FROM (SELECT np, p, a, b, CAST(m.k AS INTEGER) AS k, CAST(-m.ni AS INTEGER) AS i FROM seg WHERE m IS NOT NULL)))
    WHERE x.a <> '' AND x.b <> ''),
  ratios AS (SELECT np, p, CAST(2 * coalesce(sum(m.k), 0) AS DOUBLE) / (length(p) + length(np)) AS similarity FROM seg GROUP BY np, p)"""


def oracle(sql: str) -> str:
    """A query over the derived tables; further CTEs start with a comma."""
    return BASE + sql.strip()
