"""Months and years of a stream against plain Python, and the segment map against none."""

import datetime as dt
import os
import random
from collections import Counter, defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from isotherm.operators import linking
from isotherm.streaming.rollup import daily_summaries, period_summaries
from isotherm.streaming.run import run_available

SCHEMA = "ts timestamp, location string, value double, rain double, precipitation double, wind double, code int"
NAMES = ("value", "rain", "precipitation", "wind", "code")


def _mean(values, of=2):
    return round(float(sum(Decimal(repr(v)) for v in values)) / len(values), of) if values else None


def _total(values):
    return round(float(sum(Decimal(repr(v)) for v in values)), 2) if values else None


def _plain(rows, key):
    """``location, period`` -> summary, from readings, by way of days."""
    days = defaultdict(lambda: defaultdict(list))
    for ts, place, *values in rows:
        day = days[place, ts.date()]
        for name, v in zip(NAMES, values):
            day[name] += [] if v is None else [v]
    periods = defaultdict(list)
    for (place, date), d in days.items():
        periods[place, key(date)].append(d)
    out = {}
    for at, ds in periods.items():
        of = lambda name, fold: [fold(d[name]) for d in ds if d[name]]
        codes = Counter(of("code", max))
        exact = lambda name: [float(sum(Decimal(repr(v)) for v in d[name])) for d in ds if d[name]]
        out[at] = (
            _mean(of("value", _mean)), max(of("value", max), default=None), min(of("value", min), default=None), _total(exact("rain")),
            _total(exact("precipitation")), _mean(of("wind", max)), len(ds), min(codes, key=lambda c: (-codes[c], c)) if codes else 0,
        )
    return out


def _found(df):
    rows = df.collect()
    out = {
        (r["location"], r["period"]): (
            r["temperature_c"], r["max_temperature_c"], r["min_temperature_c"], r["rain_mm"], r["precipitation_mm"], r["wind_speed_kmh"],
            r["num_days"], r["weather_code"],
        )
        for r in rows
    }
    assert len(out) == len(rows)
    assert all(r["will_rain"] == ((r["rain_mm"] or 0) > 0) for r in rows)
    return out


def test_periods_of_a_stream(spark, tmp_path):
    """Five micro-batches over fourteen months: closed periods come once, open ones not, a late reading counts nowhere."""
    random.seed(3)
    some = lambda make, lack=0.2: None if random.random() < lack else make()
    rows = []
    for d in range(420):
        for hour in (1, 13):
            for place in ("a", "b"):
                if place == "b" and d % 3:
                    continue
                ts = dt.datetime(2023, 11, 20) + dt.timedelta(days=d, hours=hour)
                number = lambda: round(random.uniform(-9, 30), 2)
                rows.append((ts, place, some(number), some(lambda: round(random.random(), 2), 0.8), some(lambda: round(random.random(), 2)), some(number), some(lambda: random.choice([0, 3, 61, 95]))))
    late = (dt.datetime(2023, 12, 1, 5), "a", 999.0, 50.0, 50.0, 99.0, 99)
    folder, size = tmp_path / "readings", len(rows) // 5 + 1
    folder.mkdir()
    for i in range(5):
        part = rows[i * size : (i + 1) * size] + ([late] if i == 3 else [])
        path = tmp_path / f"part{i}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(path))
        [file] = path.glob("*.parquet")
        target = folder / f"{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))

    end = max(r[0] for r in rows) - dt.timedelta(hours=1)
    months = {k: v for k, v in _plain(rows, lambda d: f"{d:%Y-%m}").items() if k[1] < f"{end:%Y-%m}"}
    assert len(months) == 28 and _found(run_available(period_summaries(stream(), "month"), "months")) == months
    years = {k: v for k, v in _plain(rows, lambda d: f"{d:%Y}").items() if k[1] < f"{end:%Y}"}
    assert len(years) == 4 and _found(run_available(period_summaries(stream(), "year"), "years")) == years

    batch = spark.createDataFrame(rows, SCHEMA)
    assert _found(period_summaries(batch, "month")) == _plain(rows, lambda d: f"{d:%Y-%m}")
    days = _found(daily_summaries(batch).withColumnRenamed("day", "period"))
    assert days == _plain(rows, lambda d: f"{d:%Y-%m-%d}")


def test_readings_of_temperatures_alone(spark):
    rows = [(dt.datetime(2024, 2, 28 + d), "a", 1.0 * d) for d in range(2)]
    [r] = period_summaries(spark.createDataFrame(rows, "ts timestamp, location string, value double"), "year").collect()
    assert (r["temperature_c"], r["rain_mm"], r["wind_speed_kmh"], r["num_days"], r["weather_code"], r["will_rain"]) == (0.5, None, None, 2, 0, False)
    assert period_summaries(spark.createDataFrame([], SCHEMA), "month").count() == 0


def test_a_full_map_changes_nothing(spark, monkeypatch):
    """Linked names with maps of a megabyte, of 16 bytes and with every place filled."""
    random.seed(8)
    names = ["Saudi Arabia", "United States", "Middle East", "Peru", "North America", "Iran"]
    spoil = lambda s: "".join(c for c in s if random.random() > 0.06)
    texts = [(i, " ".join([random.choice(["in", "the", "north"]), spoil(random.choice(names)), "or", spoil(random.choice(names)).lower()])) for i in range(300)]
    texts = spark.createDataFrame([*texts, (300, ""), (301, None), (302, "é" * 40 + " arabia")], "id int, text string")
    known = linking.dictionary((spark.createDataFrame([(n,) for n in names], "name string"), "name", "Country"))
    for single in (True, False):
        found = []
        for slots in (1 << 20, 16, 1):
            monkeypatch.setattr(linking, "SLOTS", slots)
            near = linking.fuzzy_mentions(texts, "id", "text", known, 0.82, exact_single=single)
            both = linking.linked_names(texts, "id", "text", known, 0.82, exact_single=single)
            found.append((sorted(map(tuple, near.collect())), sorted(map(tuple, both.collect()))))
        assert found[0] == found[1] == found[2] and len(found[0][1]) > 200
