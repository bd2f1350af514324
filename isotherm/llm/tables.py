"""Helpers of the operators that work on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isotherm.session import materialize


staged = materialize


BITS = 26


def marked(df: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: may the row's ``key`` be one of ``wanted`` (one column)? Nothing of it is shuffled.

    A bitmap of 2 ** BITS hashed places, 8 MB whatever the size of the tables, tells most others apart; where very
    many keys are wanted it marks more rows. An exact join of the marked rows has to follow.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << BITS))
    marks = wanted.select(place(wanted.columns[0]).alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_group")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    at, group, bits = (fresh(df, n) for n in ("_place", "_group", "_bits"))
    byte = f"CAST(conv(hex(substring({bits}, CAST(bitmap_bit_position({at}) DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    there = F.expr(f"(({byte} >> CAST(bitmap_bit_position({at}) % 8 AS INT)) & 1) = 1")
    placed = df.withColumn(at, place(key)).withColumn(group, F.bitmap_bucket_number(at))
    joined = placed.join(F.broadcast(staged(marks, "marks").toDF(group, bits)), group, "left")
    return joined.withColumn(name, F.coalesce(there, F.lit(False))).drop(at, group, bits)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def smallest_by_hash(df: DataFrame, key: str, most: int, per: str | None = None) -> DataFrame:
    """At most ``most`` rows (different ones of each ``per``): those whose ``key`` hashes lowest. Bounded, and the same in every run.

    Of a large group only the rows below a hash that about 1.5 x ``most`` keys fall under are shuffled and ranked.
    """
    order = [F.xxhash64(F.col(key)), F.col(key)]
    if per is None:
        return df.orderBy(*order).limit(most)
    sizes = staged(df.groupBy(per).agg(F.approx_count_distinct(key).alias("_n")), "sizes")
    place = (F.xxhash64(F.col(key)) / F.lit(2.0**63) + 1) / 2
    few = df.join(sizes, per).where(place * F.col("_n") <= 1.5 * most + 50).distinct()
    rank = F.row_number().over(W.partitionBy(per).orderBy(*order))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_n")


def number_within(df: DataFrame, group: str, spread: list[Column], order: list[Column], buckets: int, name: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, however large a group is.

    Rows of a group are dealt over ``buckets`` by the hash of ``spread``; they are numbered inside their bucket
    and shifted by the sizes of the buckets before it. Only those sizes meet: groups x buckets rows.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy(group, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside)
        .join(F.broadcast(shifts), [group, "_bucket"])
        .withColumn(name, (F.col("_shift") + F.col("_inside") - 1).cast("long"))
        .drop("_bucket", "_shift", "_inside")
    )
