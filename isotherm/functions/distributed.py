"""Exact answers to global questions without a single-task step over the data."""

from __future__ import annotations

import math
import sys
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.session import materialize

ROWS = 100_000  # rows of a task at most whose work is heavy per row


def spread(df: DataFrame) -> DataFrame:
    """Spread a table over all cores, and over as many tasks that none has more than ROWS rows.

    For work that is heavy per row: a split of 128 MB may hold millions of short rows. A table that has
    as many splits stays as it is, without a shuffle. Counting reads no column.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is, its columns computed once: no condition on what is computed from them moves below.

    The optimizer takes the conditions of later joins down to the scan, with all expressions they read. There they run
    in as few tasks as the scan has, and again above. It moves nothing past a condition that is not deterministic.
    """
    return df.where(F.spark_partition_id() >= 0)


def _sorted_rows(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-sorted and staged, with ``_part`` and a number ``_id`` that grows by one inside each part."""
    ordered = df.orderBy(*order)
    return materialize(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "sorted")


def _before() -> W:
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, *order: Column, name: str = "row_no", total: str | None = None) -> DataFrame:
    """Row numbers of a total order over a table of any size; ``total`` adds the number of all rows.

    The table is range-sorted once and staged; rows are numbered inside their part and shifted by the sizes of
    the parts before it. Only those sizes (one row per part) meet in one task.
    """
    tagged = _sorted_rows(df, *order)
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    shift = F.coalesce(F.sum("_n").over(_before()), F.lit(0))
    whole = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = sizes.select("_part", (shift - F.col("_first") + 1).alias("_offset"), *([whole.alias(total)] if total else []))
    numbered = tagged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_id") + F.col("_offset"))
    return numbered.drop("_part", "_id", "_offset")


SKETCH = 10_000  # accuracy of the quantile sketch: it errs by 1 / SKETCH of the rows
BINS = 4096
LARGEST = sys.float_info.max


def _histogram(rows: DataFrame, low: float, high: float) -> list:
    """``bin, n, least, most`` of ``v`` in rising order: BINS equal parts of [low, high], and what lies outside."""
    low, high = max(low, -LARGEST), min(high, LARGEST)
    v = F.col("v")
    width = high / 2 - low / 2  # halves, so that the difference is finite
    part = F.lit(0) if width == 0 else F.least(F.floor((v / 2 - low / 2) / width * BINS), F.lit(BINS - 1))
    place = F.when(F.isnan(v), BINS + 1).when(v < low, -1).when(v > high, BINS).otherwise(part)
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("bin").collect()


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``median``: the middle value, or the mean of the two middle ones.

    Selection by repeated counting. A quantile sketch brackets the middle; a pass counts the rows below the bracket and
    in each of BINS equal parts of it, with the smallest and largest value of each part. The part that holds
    the middle is the next bracket, until it holds one value or the two middle ones lie in two parts. Tasks reduce
    to BINS rows before anything is shuffled, and no value is ever sorted; a pass narrows a bracket 4096 times, so that
    one or two are enough for most tables.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    low, high, n = rows.agg(
        F.percentile_approx("v", 0.5 - 2 / SKETCH, SKETCH), F.percentile_approx("v", 0.5 + 2 / SKETCH, SKETCH), F.count("*")
    ).first()
    middle = None
    while n and middle is None:
        before = 0
        for this, after in pairwise([*_histogram(rows, low, high), None]):
            if before + this["n"] >= (n + 1) // 2:
                break
            before += this["n"]
        if before + this["n"] < (n + 2) // 2:
            middle = (this["most"] + after["least"]) / 2
        elif this["least"] == this["most"] or math.isnan(this["least"]):
            middle = this["least"]
        else:
            low, high = this["least"], this["most"]
    return df.sparkSession.range(1).select(F.lit(middle).cast("double").alias("median"))


def carry_forward(
    df: DataFrame, key: str, order: str, value: Column, name: str, keep: str = "last", block: int = 65_536, levels: int = 1
) -> DataFrame:
    """``keep`` ("last" / "first") non-null ``value`` of the earlier rows of the same ``key``; see ``carry_all``."""
    return carry_all(df, key, order, {name: (value, keep)}, block, levels)


def carry_all(
    df: DataFrame,
    key: str,
    order: str,
    values: dict[str, tuple[Column, str]],
    block: int = 65_536,
    levels: int = 1,
) -> DataFrame:
    """For each name of ``values`` (value, "last" or "first"): that non-null value of the earlier rows of the same ``key``.

    A key may hold a large share of all rows, so its rows are cut into blocks of the
    integer ``order``. One window runs inside each block; what the blocks hand on is
    carried in the same way over one row per block, ``levels`` times, so that the one
    window over a whole key sees a row per ``block ** levels`` steps of ``order``.
    ``(key, order)`` must be unique; for a wide ``order`` such as microseconds take
    two levels.
    """
    over = {"last": F.last, "first": F.first}
    earlier = lambda *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if levels == 0:
        return df.withColumns({n: over[keep](value, ignorenulls=True).over(earlier(key)) for n, (value, keep) in values.items()})
    b, at = f"_block{levels}", {n: [f"_{c}{levels}_{i}" for c in ("value", "near", "end", "far")] for i, n in enumerate(values)}
    cut = df.withColumns({at[n][0]: value for n, (value, _) in values.items()}).withColumn(b, F.floor(F.col(order) / block))
    inside = cut.withColumns({at[n][1]: over[keep](at[n][0], ignorenulls=True).over(earlier(key, b)) for n, (_, keep) in values.items()})
    by = {"last": F.max_by, "first": F.min_by}
    ends = cut.groupBy(key, b).agg(
        *[by[keep](at[n][0], F.when(F.col(at[n][0]).isNotNull(), F.col(order))).alias(at[n][2]) for n, (_, keep) in values.items()]
    )
    handed = carry_all(ends, key, b, {at[n][3]: (F.col(at[n][2]), keep) for n, (_, keep) in values.items()}, block, levels - 1)
    joined = inside.join(handed.select(key, b, *[at[n][3] for n in values]), [key, b], "left")
    pick = {n: F.coalesce(*([at[n][1], at[n][3]] if keep == "last" else [at[n][3], at[n][1]])) for n, (_, keep) in values.items()}
    return joined.withColumns(pick).drop(b, *[c for n in values for c in at[n] if c != at[n][2]])
