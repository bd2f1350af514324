"""Sharding: longest processing time first, over groups that stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.tables import number_within, staged


def longest_first(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Unit -> shard: units by falling size (ties by number), each to the least loaded shard (ties: the lowest)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[unit] = shard
    return placed


def shard(docs: DataFrame, shards: int = 8, bundles: int = 4096, slot_buckets: int = 512) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its size, checksum, shard and slot; equal texts share a shard.

    The schedule is kept small whatever the number of groups: groups of more than 1 / ``bundles`` of all bytes
    (fewer than ``bundles``) are units by themselves, all others are dealt by their hash into ``bundles`` units.
    So at most 2 x ``bundles`` rows reach the driver's heap, and the loads differ by about one small unit.
    A null text counts as an empty one. Repeated rows each take a slot.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod("_key", F.lit(bundles))
    alone = F.col("_size") * bundles > total
    groups = staged(groups, "shard-groups")
    large = {r["_key"]: r["_size"] for r in groups.where(alone).collect()}
    small = groups.where(~alone).groupBy(bundle.alias("_unit")).agg(F.sum("_size").alias("_size")).collect()
    number = {key: bundles + i for i, key in enumerate(sorted(large))}
    placed = longest_first([(number[k], s) for k, s in large.items()] + [(r["_unit"], r["_size"]) for r in small], shards)

    spark = docs.sparkSession
    keys = spark.createDataFrame([(k, n) for k, n in number.items()], "_key long, _own int")
    units = spark.createDataFrame(list(placed.items()), "_unit int, shard int")
    placed_rows = (
        rows.join(F.broadcast(keys), "_key", "left")
        .withColumn("_unit", F.coalesce("_own", bundle.cast("int")))
        .join(F.broadcast(units), "_unit")
    )
    numbered = number_within(placed_rows, "shard", [F.col("doc_id"), F.col("_key")], [F.col("doc_id"), F.col("_key")], slot_buckets, "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
