"""Connected components of a graph of links, as jobs over its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.tables import staged

AT_ONCE = 2_000_000  # edges that a task contracts at once


def hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, smallest id it reaches`` by the given links, for all nodes but those smallest ones."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def contract(batches):
    """Arrow batches of links (a, b) as links of each node to the smallest one it reaches within a task's own links."""

    def out(parts):
        a, b = hung(*(np.concatenate(p) for p in zip(*parts)))
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append([batch.column(c).to_numpy() for c in ("a", "b")])
            held += batch.num_rows
        if held >= AT_ONCE:
            yield out(parts)
            parts, held = [], 0
    if parts:
        yield out(parts)


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node, which hangs on none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    counted = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where((F.col("up") > 1) | (F.col("up") * F.col("down") > 0)).limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """``id, component``: for every node of ``links`` (a, b) the smallest id that can be reached.

    Tasks first contract the links they hold. Then large-star and small-star rounds: every node's neighbours
    are hung on its smallest one, until all hang on their component's smallest id. A round halves long paths;
    each is a written table. A hub's edges are aggregated before they are shuffled, and joins on a hub are dealt
    anew as skewed joins.
    """
    edges = links.where("a <> b").mapInArrow(contract, "a long, b long").distinct()
    edges = staged(edges, "edges")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))
        large = staged(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = staged(small.distinct(), "small-star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
