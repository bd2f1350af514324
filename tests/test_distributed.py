"""Distributed building blocks against plain Python, also with one dominant key."""

import random
import statistics

from pyspark.sql import functions as F

from isotherm.functions import distributed
from isotherm.functions.distributed import carry_forward, exact_median, number_rows, settled, spread
from isotherm.session import clear_work, materialize, new_work_path
from isotherm.sources.delimited import path_exists


def test_median(spark):
    random.seed(5)
    for n in (1, 2, 7, 500, 501, 30_001):
        values = [random.choice([1.5, 2.0, 7.25, random.random() * 9]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
        assert exact_median(df, "v").first()[0] == statistics.median(values)


def test_median_of_odd_values(spark, monkeypatch):
    """Few bins, so that many passes narrow the bracket; far ends, infinities, NaN above all, decimals and whole numbers."""
    monkeypatch.setattr(distributed, "BINS", 4)
    monkeypatch.setattr(distributed, "SKETCH", 4)
    inf, nan = float("inf"), float("nan")
    cases = [
        [0.0, 1e-9, 1.0, 1.0 + 1e-9], [-1.7e308, 1.7e308, 1.6e308], [-inf, -inf, 3.0, inf, inf], [-inf, inf, 1.0, 2.0], [1.0, 2.0, nan, nan],
        [1.0, nan, nan], [5e-324, 0.0, -5e-324], [float(x * x) for x in range(1001)], [2.0] * 7, [1.0, 1.0, 1.0, 9.0, 9.0, 9.0],
    ]
    for values in cases:
        ordered = sorted(values, key=lambda v: (v != v, v))
        low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
        want = low if low == high else (low + high) / 2
        got = exact_median(spark.createDataFrame([(v,) for v in values], "v double").repartition(3), "v").first()[0]
        assert got == want or (got != got and want != want)
    assert exact_median(spark.createDataFrame([("1.25",), ("3.75",)], "v string").select(F.col("v").cast("decimal(9,2)")), "v").first()[0] == 2.5
    assert exact_median(spark.createDataFrame([], "v double"), "v").first()[0] is None


def test_median_of_many_values(spark, monkeypatch):
    """A million distinct values: what is gathered is one row per bin, in two passes, and nothing is sorted but bins."""
    seen = []
    count = distributed._histogram
    monkeypatch.setattr(distributed, "_histogram", lambda *a: seen.append(len(found := count(*a))) or found)
    rows = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003 / 8).alias("v"))
    found = exact_median(rows, "v")
    values = sorted(i * 7919 % 1_000_003 / 8 for i in range(1_000_000))
    assert found.first()[0] == (values[499_999] + values[500_000]) / 2
    assert len(seen) <= 2 and max(seen) <= distributed.BINS + 3
    assert "Window" not in found._jdf.queryExecution().toString()


def test_row_numbers(spark):
    random.seed(6)
    rows = [(i, random.choice([1, 1, 1, random.randint(0, 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(7)
    got = {r["id"]: r["row_no"] for r in number_rows(df, F.asc("v"), F.asc("id")).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_carry_forward(spark):
    random.seed(7)
    rows = []
    for key, n in ((1, 900), (2, 40), (3, 1), (4, 25)):
        turns = sorted(random.sample(range(3000), n))
        rows += [(key, t, random.choice([None, None, "x", "y", "z"])) for t in turns]
    df = spark.createDataFrame(rows, "k int, t int, v string").repartition(6)
    for keep, levels in (("last", 1), ("first", 1), ("last", 2), ("first", 3)):
        carried = carry_forward(df, "k", "t", F.col("v"), "c", keep, block=16, levels=levels)
        got = {(r["k"], r["t"]): r["c"] for r in carried.collect()}
        for key, turn, _ in rows:
            seen = [v for k, t, v in rows if k == key and t < turn and v is not None]
            assert got[key, turn] == ((seen[-1] if keep == "last" else seen[0]) if seen else None)


def test_staged_tables(spark):
    """A written table is broadcast by its known size, and goes with ``clear_work``."""
    small = materialize(spark.range(10).withColumnRenamed("id", "k"))
    assert "broadcast" in spark.range(100).join(small, F.col("id") == F.col("k"))._jdf.queryExecution().toString().lower()
    folder = new_work_path(spark, "gone")
    spark.range(3).write.parquet(folder)
    clear_work(spark)
    assert not path_exists(spark, folder)


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(distributed, "ROWS", 50)
    dealt = spread(spark.range(0, 2001, 1, 1))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2001 and len(sizes) == 41
    assert spread(dealt).rdd.getNumPartitions() == 41


def test_conditions_stay_above_what_is_settled(spark):
    """A join's condition on a computed column is not taken below the exchange, where there are few tasks."""
    rows = settled(spread(spark.range(0, 100, 1, 1)).select("id", F.concat(F.lit("x"), "id").alias("text")))
    names = spark.createDataFrame([("X7", 1)], "up string, n int")
    joined = rows.select("id", F.nullif(F.upper("text"), F.lit("")).alias("up")).join(names, "up")
    assert [tuple(r) for r in joined.select("id", "n").collect()] == [(7, 1)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(" in plan and "upper(" not in plan[plan.index("Repartition"):]
