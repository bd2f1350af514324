"""A yearly panel with known trend tables, built from base values and yearly offsets."""

from isotherm.operators.cleaning import clean_panel
from isotherm.operators.panel import build_yearly
from isotherm.operators.trends import country_trends, fastest_warming_regions, hottest_countries, regional_trends
from isotherm.schemas import RAW_PANEL

# Offsets to the first year 1980, one list per group of countries.
COMMON = [0.0, 0.3, 0.1, 0.6, 0.2, 0.7, 1.0, 0.5, 0.3, 0.8, 1.2, 0.7, 1.1, 1.4, 0.9, 1.6, 1.2, 1.8, 1.4, 1.9]
OTHER = {
    "Afghanistan": [0.0, 0.3, 0.1, 0.6, 0.2, 0.5, 0.8, 0.4, 0.1, 0.7, 1.0, 0.6, 0.9, 1.2, 0.7, 1.4, 1.0, 1.6, 1.2, 1.7],
    "Australia": [0.0, 0.3, 0.8, 0.5, 0.2, 0.6, 1.0, 0.4, 0.1, 0.7, 0.3, -0.1, 1.1, 1.5, 1.2, 1.8, 1.4, 2.0, 2.3, 1.7],
    "Canada": [0.0, 0.3, 0.1, 0.6, 0.2, 0.5, 0.8, 0.4, 0.0, 0.6, 1.0, 0.3, 0.9, 1.2, 0.7, 1.4, 1.8, 1.3, 1.6, 2.0],
    "United States": [0.0, 0.3, 0.1, 0.7, 0.2, 0.7, 1.0, 0.5, 0.3, 0.8, 1.2, 0.7, 1.1, 1.4, 0.9, 1.6, 1.2, 1.8, 1.4, 1.9],
}
OTHER["Argentina"] = OTHER["Afghanistan"]

# Region and value of the first year.
BASES = {
    "Africa": {"Egypt": 18.8, "Ethiopia": 17.1, "Ghana": 25.5, "Kenya": 18.3, "Morocco": 16.0, "Nigeria": 25.3,
               "South Africa": 14.6, "Sudan": 24.1, "Tanzania": 20.1, "Uganda": 19.6},
    "Asia": {"Afghanistan": 11.2, "China": 6.5, "India": 21.1, "Indonesia": 24.4, "Japan": 10.2, "Malaysia": 25.1,
             "Pakistan": 18.8, "Philippines": 25.6, "South Korea": 9.5, "Thailand": 24.8, "Vietnam": 22.3},
    "Middle East": {"Iran": 15.1, "Iraq": 18.6, "Saudi Arabia": 22.3, "Turkey": 10.3},
    "North America": {"Canada": -3.2, "Mexico": 16.5, "United States": 7.2},
    "South America": {"Argentina": 13.1, "Brazil": 23.5, "Colombia": 20.3, "Peru": 17.3, "Venezuela": 22.9},
    "Oceania": {"Australia": 20.1, "New Zealand": 10.6},
}

# First and latest mean, mean, change, slope and volatility per region.
REGIONS = {
    "North America": (6.833, 8.767, 7.687, 1.933, 0.0851, 0.4152),
    "Africa": (19.94, 21.84, 20.825, 1.9, 0.0847, 0.4447),
    "Middle East": (16.575, 18.475, 17.46, 1.9, 0.0847, 0.4447),
    "Asia": (18.136, 20.018, 19.009, 1.882, 0.0837, 0.4426),
    "South America": (19.42, 21.28, 20.278, 1.86, 0.0824, 0.4402),
    "Oceania": (15.35, 17.15, 16.237, 1.8, 0.0894, 0.4176),
}

# The ten countries with the highest latest value, and that value and the mean.
HOTTEST = [
    ("Philippines", 27.5, 26.485), ("Ghana", 27.4, 26.385), ("Nigeria", 27.2, 26.185), ("Malaysia", 27.0, 25.985),
    ("Thailand", 26.7, 25.685), ("Indonesia", 26.3, 25.285), ("Sudan", 26.0, 24.985), ("Brazil", 25.4, 24.385),
    ("Venezuela", 24.8, 23.785), ("Vietnam", 24.2, 23.185),
]


def panel_rows():
    for region, countries in BASES.items():
        for country, base in countries.items():
            for i, step in enumerate(OTHER.get(country, COMMON)):
                yield country, region, str(1980 + i), f"{base + step:.1f}"


def yearly(spark):
    return build_yearly(clean_panel(spark.createDataFrame(list(panel_rows()), RAW_PANEL)))


def test_country_trends(spark):
    rows = {r["Country"]: r for r in country_trends(yearly(spark)).collect()}
    assert len(rows) == 35
    for region, countries in BASES.items():
        for country, base in countries.items():
            row = rows[country]
            assert (row["Region"], row["FirstYear"], row["LatestYear"]) == (region, 1980, 1999)
            assert row["FirstTemperature"] == base
            if country not in OTHER:
                assert row["LatestTemperature"] == round(base + 1.9, 3)
                assert (row["TemperatureChange"], row["WarmingTrendPerYear"], row["VolatilityScore"]) == (1.9, 0.0847, 0.4447)
                assert (row["HottestYear"], row["HottestTemperature"]) == (1999, round(base + 1.9, 3))
    canada = rows["Canada"]
    assert canada.asDict() == {
        "Region": "North America", "Country": "Canada", "FirstYear": 1980, "LatestYear": 1999, "FirstTemperature": -3.2,
        "LatestTemperature": -1.2, "AverageTemperature": -2.415, "TemperatureChange": 2.0, "WarmingTrendPerYear": 0.0867,
        "VolatilityScore": 0.4527, "HottestYear": 1999, "HottestTemperature": -1.2,
    }


def test_regional_trends(spark):
    regions = regional_trends(yearly(spark))
    got = {r["Region"]: tuple(r)[3:] for r in regions.collect()}
    # The exact mean of Oceania is 16.2375; the known value comes from a float sum just below it.
    assert got.pop("Oceania") == (15.35, 17.15, 16.238, 1.8, 0.0894, 0.4176)
    assert got == {region: values for region, values in REGIONS.items() if region != "Oceania"}
    assert [r["Region"] for r in fastest_warming_regions(regions).collect()] == [
        "North America", "Africa", "Middle East", "Asia", "South America"
    ]


def test_hottest_countries(spark):
    top = hottest_countries(country_trends(yearly(spark))).collect()
    assert [(r["Country"], r["LatestTemperature"], r["AverageTemperature"]) for r in top] == HOTTEST
