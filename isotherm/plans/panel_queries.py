"""Yearly panel, trend tables and rankings."""

from pyspark.sql import functions as F

from isotherm.functions.distributed import number_rows
from isotherm.operators import panel, profile, ranking, selection, trends
from isotherm.plans.catalog import query
from isotherm.plans.oracle import DEC_MEAN, r
from isotherm.plans.reports import build_bundle

COUNTRY_TIES = "TemperatureChange DESC, WarmingTrendPerYear DESC, Region, Country"
REGION_TIES = "RegionalTemperatureChange DESC, RegionalWarmingTrendPerYear DESC, Region"
HOTTEST = f"SELECT * FROM country_trends ORDER BY LatestTemperature DESC, AverageTemperature DESC, {COUNTRY_TIES} LIMIT 10"
FASTEST = f"SELECT * FROM regional_trends ORDER BY {REGION_TIES} LIMIT 5"


@query("ag01_yearly_means", "SELECT * FROM means")
def _(w):
    return w.means


@query("ag02_regional_means", "SELECT * FROM regional")
def _(w):
    return panel.regional_means(w.means)


@query("jn02_yearly_panel", "SELECT * FROM yearly")
def _(w):
    return w.yearly


@query("wn01_year_over_year", "SELECT Country, Region, Year, TempChange FROM yearly")
def _(w):
    return panel.with_changes(w.means).select("Country", "Region", "Year", "TempChange")


@query("wn02_baseline", "SELECT Country, Region, Year, BaselineTemperature FROM yearly")
def _(w):
    return panel.with_changes(w.means).select("Country", "Region", "Year", "BaselineTemperature")


@query("prj11_change_from_baseline", "SELECT Country, Region, Year, TotalTempChange FROM yearly")
def _(w):
    return panel.with_changes(w.means).select("Country", "Region", "Year", "TotalTempChange")


@query(
    "wn03_regional_change",
    "SELECT DISTINCT Region, Year, RegionalAverageTemperature, RegionalTempChange FROM yearly",
)
def _(w):
    return panel.regional_changes(panel.regional_means(w.means))


@query(
    "ag03_first_latest",
    "SELECT Region, Country, FirstYear, LatestYear, FirstTemperature, LatestTemperature, TemperatureChange FROM country_trends",
)
def _(w):
    return w.country_trends.select(
        "Region", "Country", "FirstYear", "LatestYear", "FirstTemperature", "LatestTemperature", "TemperatureChange"
    )


@query("ag04_trend_slope", "SELECT Region, Country, WarmingTrendPerYear FROM country_trends")
def _(w):
    return w.country_trends.select("Region", "Country", "WarmingTrendPerYear")


@query("ag05_volatility", "SELECT Region, Country, VolatilityScore FROM country_trends")
def _(w):
    return w.country_trends.select("Region", "Country", "VolatilityScore")


@query("ag06_hottest_year", "SELECT Region, Country, HottestYear, HottestTemperature FROM country_trends")
def _(w):
    return w.country_trends.select("Region", "Country", "HottestYear", "HottestTemperature")


@query("ag07_country_trends", "SELECT * FROM country_trends")
def _(w):
    return w.country_trends


@query("ag08_regional_trends", "SELECT * FROM regional_trends")
def _(w):
    return w.regional_trends


@query("tk01_sorted_trends", f"SELECT *, row_number() OVER (ORDER BY {COUNTRY_TIES}) AS rank FROM country_trends")
def _(w):
    return number_rows(w.country_trends, *trends.country_order(), name="rank")


@query("tk02_fastest_regions", FASTEST)
def _(w):
    return trends.fastest_warming_regions(w.regional_trends)


@query("tk03_hottest_countries", HOTTEST)
def _(w):
    return trends.hottest_countries(w.country_trends)


def _tagged(section, entity, metric, source, order, n=10, where="TRUE"):
    return (
        f"SELECT '{section}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, {entity} AS entity, "
        f"'{metric}' AS metric, {metric} AS value FROM {source} WHERE {where} "
        f"QUALIFY row_number() OVER (ORDER BY {order}) <= {n}"
    )


def _union(*parts):
    return " UNION ALL ".join(f"({p})" for p in parts)


@query(
    "tk04_most_volatile",
    _union(
        _tagged("countries", "Country", "VolatilityScore", "country_trends", "VolatilityScore DESC, Country"),
        _tagged("regions", "Region", "RegionalVolatilityScore", "regional_trends", "RegionalVolatilityScore DESC, Region"),
    ),
)
def _(w):
    parts = []
    for section, df, entity, metric in (
        ("countries", w.country_trends, "Country", "VolatilityScore"),
        ("regions", w.regional_trends, "Region", "RegionalVolatilityScore"),
    ):
        top = ranking.ranked(df.where(F.col(metric).isNotNull()), [F.desc(metric), F.asc(entity)], 10)
        parts.append(
            top.select(F.lit(section).alias("section"), "rank", F.col(entity).alias("entity"),
                       F.lit(metric).alias("metric"), F.col(metric).alias("value"))
        )
    return parts[0].unionByName(parts[1])


@query(
    "tk05_most_stable",
    "SELECT Country, Region, VolatilityScore, TemperatureChange FROM country_trends ORDER BY VolatilityScore, Region, Country LIMIT 10",
)
def _(w):
    top = ranking.top_k(w.country_trends, "VolatilityScore", 10, ascending=True, ties=["Region", "Country"])
    return top.select("Country", "Region", "VolatilityScore", "TemperatureChange")


@query(
    "tk06_directional_ranking",
    _union(
        _tagged("countries", "Country", "TemperatureChange", "country_trends", "TemperatureChange, Country, Region"),
        _tagged("regions", "Region", "RegionalTemperatureChange", "regional_trends", "RegionalTemperatureChange, Region"),
    ),
)
def _(w):
    return ranking.directional_ranking(w.country_trends, w.regional_trends, True, True, 10)


@query(
    "tk07_ranked_lists",
    _union(
        _tagged("hottest", "Country", "AverageTemperature", "country_trends", "AverageTemperature DESC, Region, Country"),
        _tagged("coolest", "Country", "AverageTemperature", "country_trends", "AverageTemperature, Region, Country"),
        _tagged("fastest", "Country", "TemperatureChange", "country_trends", "TemperatureChange DESC, Region, Country"),
        _tagged("cooling", "Country", "TemperatureChange", "country_trends", "TemperatureChange, Region, Country", where="TemperatureChange < 0"),
    ),
)
def _(w):
    from isotherm.plans.reports import country_rankings

    return country_rankings(w.country_trends, 10).where("section <> 'most_stable'")


@query(
    "tk08_extremes_of_year",
    _union(
        _tagged("hottest", "Country", "AvgTemperature", "means", "AvgTemperature DESC, Country, Region", where="Year = 1998"),
        _tagged("coldest", "Country", "AvgTemperature", "means", "AvgTemperature, Country, Region", where="Year = 1998"),
    ),
)
def _(w):
    from isotherm.plans.reports import year_extremes

    return year_extremes(w.means, 1998, 10)


@query(
    "tk09_numeric_sort",
    ", n AS (SELECT o_orderkey, TRY_CAST(trim(AvgTemperature) AS DOUBLE) AS v FROM dirty) "
    "SELECT o_orderkey, row_number() OVER (ORDER BY v DESC, o_orderkey) AS rank FROM n WHERE v IS NOT NULL AND NOT isnan(v)",
)
def _(w):
    return ranking.sort_numeric(w.dirty, "AvgTemperature", ties=["o_orderkey"], name="rank").select("o_orderkey", "rank")


@query(
    "tk11_top_by_magnitude",
    """, e AS (SELECT Country || ' ' || Year AS label, TempChange AS value FROM yearly),
    t AS (SELECT *, row_number() OVER (ORDER BY abs(value) DESC, label) AS rank FROM e)
    SELECT label, value, CAST(rank AS INTEGER) AS rank, abs(value) / (SELECT max(abs(value)) FROM e) * 100 AS share FROM t WHERE rank <= 10""",
)
def _(w):
    labelled = w.yearly.select(F.concat_ws(" ", "Country", "Year").alias("name"), "TempChange")
    return ranking.top_by_magnitude(labelled, "name", "TempChange", 10)


@query(
    "tk12_page",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 25 "
    "OFFSET (SELECT least(479, (count(*) - 1) // 25) * 25 FROM orders)",
)
def _(w):
    orders = w.table("orders").select("o_orderkey", "o_totalprice")
    return ranking.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 480, name="rank")


@query(
    "tk12_last_page",
    "SELECT Country, Region, Year, AvgTemperature, row_number() OVER (ORDER BY Country, Region, Year) AS rank FROM means ORDER BY rank "
    "LIMIT 25 OFFSET (SELECT (count(*) - 1) // 25 * 25 FROM means)",
)
def _(w):
    return ranking.page(w.means, [F.asc("Country"), F.asc("Region"), F.asc("Year")], 9999, name="rank")


@query(
    "tk13_regional_ranking",
    _union(
        _tagged("hottest", "Region", "AverageRegionalTemperature", "regional_trends", "AverageRegionalTemperature DESC, Region"),
        _tagged("fastest", "Region", "RegionalTemperatureChange", "regional_trends", "RegionalTemperatureChange DESC, Region"),
    ),
)
def _(w):
    from isotherm.plans.reports import region_rankings

    return region_rankings(w.regional_trends, 10)


@query(
    "wn04_latest_years",
    "SELECT Country, Region, Year, AvgTemperature FROM means "
    "QUALIFY row_number() OVER (PARTITION BY Country ORDER BY Year DESC, Region) <= 5",
)
def _(w):
    return ranking.latest_rows(w.means, 5)


@query(
    "wn05_rank_numbers",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
)
def _(w):
    orders = w.table("orders").select("o_orderkey", "o_totalprice")
    return number_rows(orders, F.desc("o_totalprice"), F.asc("o_orderkey"), name="rank").select("o_orderkey", "rank")


@query(
    "wn06_share_of_largest",
    "SELECT Country, Region, Year, least(100, abs(TempChange) / (SELECT max(abs(TempChange)) FROM yearly) * 100) AS share FROM yearly",
)
def _(w):
    return ranking.with_share(w.yearly, "TempChange").select("Country", "Region", "Year", "share")


@query(
    "wn07_last_periods",
    f"SELECT Year, {DEC_MEAN.format('AvgTemperature', 3)} AS GlobalAverage FROM means GROUP BY Year "
    "ORDER BY Year DESC LIMIT 4",
)
def _(w):
    return profile.last_periods(w.means, 4)


@query("flt03_region_filter", "SELECT * FROM means WHERE Region = 'Middle East'")
def _(w):
    return selection.filter_region(w.means, "  middle EAST ")


@query(
    "flt04_year_filter",
    "SELECT 'present' AS part, * FROM means WHERE Year = 1997 UNION ALL SELECT 'absent', * FROM means",
)
def _(w):
    present = selection.filter_year(w.means, 1997).select(F.lit("present").alias("part"), "*")
    return present.unionByName(selection.filter_year(w.means, 1850).select(F.lit("absent").alias("part"), "*"))


@query("flt05_latest_year", "SELECT * FROM means WHERE Year = (SELECT max(Year) FROM means)")
def _(w):
    return selection.latest_year_rows(w.means)


@query("flt06_cooling", "SELECT * FROM country_trends WHERE TemperatureChange < 0")
def _(w):
    return selection.cooling(w.country_trends)


@query(
    "flt07_search",
    "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'mach') "
    "OR contains(lower(c_name), 'mach')",
)
def _(w):
    return selection.search_rows(w.table("customer").select("c_name", "c_mktsegment", "c_custkey"), " MACH ")


@query(
    "flt08_relevant_rows",
    "SELECT p_partkey FROM part WHERE regexp_matches(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type)), 'small|ring|there')",
)
def _(w):
    parts = w.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
    return selection.relevant_rows(parts, "tell me: is there a small ring").select("p_partkey")


@query(
    "ag09_region_stats",
    "SELECT Region, round_even(sum(CAST(AvgTemperature AS DECIMAL(28,3)))::DOUBLE / count(*) * 100, 0) / 100 AS AvgTemperature FROM means GROUP BY Region",
)
def _(w):
    return profile.region_stats(w.means.withColumn("AvgTemperature", F.col("AvgTemperature").cast("decimal(28,3)")))


@query(
    "ag10_top_hottest",
    "SELECT Country, round_even(sum(AvgTemperature)::DOUBLE / count(*) * 100, 0) / 100 AS AvgTemperature FROM panel GROUP BY Country "
    "ORDER BY AvgTemperature DESC, Country LIMIT 7",
)
def _(w):
    return profile.top_hottest(w.panel, 7)


@query(
    "ag11_top_countries",
    f"SELECT Country, {DEC_MEAN.format('TemperatureChange', 3)} AS TemperatureChange, max(LatestTemperature) AS LatestTemperature, "
    f"{DEC_MEAN.format('WarmingTrendPerYear', 4)} AS WarmingTrendPerYear FROM country_trends GROUP BY Country "
    "ORDER BY 2 DESC, Country LIMIT 10",
)
def _(w):
    return profile.top_countries(w.country_trends, 10)


@query(
    "ag12_column_statistics",
    f""", s AS (SELECT count(AvgTemperature) AS n, {DEC_MEAN.format('AvgTemperature', 3)} AS mean, median(AvgTemperature::DOUBLE) AS median,
      min(AvgTemperature)::DOUBLE AS lo, max(AvgTemperature)::DOUBLE AS hi, stddev_samp(AvgTemperature::DOUBLE) AS std FROM panel)
    SELECT n, {r('mean', 3)} AS mean, {r('median', 3)} AS median, {r('lo', 3)} AS min, {r('hi', 3)} AS max,
      {r('std', 3)} AS std, {r('hi - lo', 3)} AS range FROM s""",
)
def _(w):
    return profile.column_statistics(w.panel, "AvgTemperature")


@query(
    "ag13_metadata",
    "SELECT count(*) AS n_rows, 4 AS n_columns, count(DISTINCT Country) AS n_countries, count(DISTINCT Region) AS n_regions, "
    "count(DISTINCT Year) AS n_years, min(Year) AS first_year, max(Year) AS last_year FROM panel",
)
def _(w):
    return profile.table_metadata(w.panel)


@query(
    "ag14_distinct_list",
    "SELECT count(*) AS n, string_agg(Country, ', ' ORDER BY Country) AS names FROM (SELECT DISTINCT Country FROM panel)",
)
def _(w):
    return profile.distinct_list(w.panel, "Country")


@query(
    "ag15_global_summary",
    f""", g AS (SELECT Year, {DEC_MEAN.format('AvgTemperature', 3)} AS v FROM means GROUP BY Year),
    s AS (SELECT arg_min(v, Year) AS f, arg_max(v, Year) AS l, max(v) AS hi, min(v) AS lo FROM g)
    SELECT (SELECT min(Year) FROM g) AS first_year, {r('f', 3)} AS first_average, (SELECT max(Year) FROM g) AS latest_year,
      {r('l', 3)} AS latest_average, {r('l - f', 3)} AS change, (SELECT min(Year) FROM g WHERE v = hi) AS hottest_year,
      {r('hi', 3)} AS hottest_average, (SELECT min(Year) FROM g WHERE v = lo) AS coldest_year, {r('lo', 3)} AS coldest_average FROM s""",
)
def _(w):
    return profile.global_summary(w.means)


@query(
    "ag15_global_series",
    f"SELECT Year, count(*) AS n_rows, {DEC_MEAN.format('AvgTemperature', 3)} AS GlobalAverage FROM means GROUP BY Year",
)
def _(w):
    return profile.global_by_year(w.means)


@query(
    "ag16_one_year",
    f", s AS (SELECT count(*) AS n_rows, {DEC_MEAN.format('AvgTemperature', 3)} AS v FROM means WHERE Year = 1999) "
    f"SELECT 1999 AS Year, n_rows, {r('v', 3)} AS GlobalAverage FROM s",
)
def _(w):
    return profile.year_summary(w.means, 1999)


@query(
    "ag21_dashboard",
    f"SELECT (SELECT count(*) FROM means) AS n_rows, (SELECT count(DISTINCT Country) FROM country_trends) AS n_countries, "
    f"(SELECT count(DISTINCT Region) FROM regional_trends) AS n_regions, "
    f"(SELECT Region FROM regional_trends ORDER BY {REGION_TIES} LIMIT 1) AS fastest_region",
)
def _(w):
    return profile.dashboard(w.means, w.country_trends, w.regional_trends)


_KINDS = {
    "o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
    "o_orderdate": "date", "o_orderpriority": "categorical", "day_text": "date",
}


@query(
    "ag22_column_kinds",
    """, c AS (SELECT o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders),
    k AS (SELECT count(o_orderstatus) = count(TRY_CAST(o_orderstatus AS TIMESTAMP)) AS a,
      count(o_orderpriority) = count(TRY_CAST(o_orderpriority AS TIMESTAMP)) AS b,
      count(day_text) = count(TRY_CAST(day_text AS TIMESTAMP)) AS d FROM c)
    SELECT * FROM (VALUES (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'date'))
      v(position, "column", kind)
    UNION ALL SELECT 2, 'o_orderstatus', CASE WHEN a THEN 'date' ELSE 'categorical' END FROM k
    UNION ALL SELECT 5, 'o_orderpriority', CASE WHEN b THEN 'date' ELSE 'categorical' END FROM k
    UNION ALL SELECT 6, 'day_text', CASE WHEN d THEN 'date' ELSE 'categorical' END FROM k""",
)
def _(w):
    orders = w.table("orders").withColumn("day_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return profile.column_kinds(orders)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "ag23_category_statistics",
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS \"column\", {r('m', 6)} AS mean, lo AS min, hi AS max, {r('sd', 6)} AS std FROM "
        f"(SELECT l_returnflag, {DEC_MEAN.format(c, 2)} AS m, min({c}) AS lo, max({c}) AS hi, stddev_samp({c}) AS sd FROM lineitem GROUP BY l_returnflag)"
        for c in _MEASURES
    ),
)
def _(w):
    from isotherm.functions.numbers import round_to

    items = w.table("lineitem").select("l_returnflag", *[F.col(c).cast("decimal(18,2)") for c in _MEASURES])
    stats = profile.category_statistics(items, "l_returnflag")
    return stats.withColumns({"mean": round_to(F.col("mean"), 6), "std": round_to(F.col("std"), 6)})


@query(
    "tk10_top_rows_per_column",
    " UNION ALL ".join(
        f"(SELECT '{c}' AS ranked_by, l_orderkey, l_linenumber, l_partkey, {', '.join(_MEASURES)} FROM lineitem "
        f"ORDER BY {c} DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 10)"
        for c in _MEASURES
    ),
)
def _(w):
    items = w.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_MEASURES)
    return profile.top_rows_per_column(items, _MEASURES, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


@query(
    "rp01_analytics_bundle",
    f""", parts AS (
      SELECT 'yearly' AS section, Country AS entity, Year, AvgTemperature AS value FROM yearly
      UNION ALL SELECT 'country_trends', Country, LatestYear, LatestTemperature FROM country_trends
      UNION ALL SELECT 'regional_trends', Region, LatestYear, LatestRegionalTemperature FROM regional_trends
      UNION ALL SELECT 'fastest_regions', Region, LatestYear, LatestRegionalTemperature FROM ({FASTEST})
      UNION ALL SELECT 'hottest_countries', Country, LatestYear, LatestTemperature FROM ({HOTTEST}))
    SELECT * FROM parts""",
)
def _(w):
    out = None
    for name, df in build_bundle(w.panel).items():
        entity = "Region" if "regions" in name or name.startswith("regional") else "Country"
        value = next(c for c in ("LatestTemperature", "LatestRegionalTemperature", "AvgTemperature") if c in df.columns)
        year = "LatestYear" if "LatestYear" in df.columns else "Year"
        part = df.select(F.lit(name).alias("section"), F.col(entity).alias("entity"), F.col(year).alias("Year"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
