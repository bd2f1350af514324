"""Filter interaction audit: removals of all 32 coalitions of five filters, Shapley values by exact constrained least squares."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.llm.batches import WordHasher, bytes_of, row_blocks
from isotherm.llm.tables import staged

FILTERS = "ABCDE"
COALITIONS = 1 << len(FILTERS)
_byte = np.arange(256)
CAPITAL = (_byte >= 65) & (_byte <= 90)
SIGN = np.isin(_byte, list(b"#$%&*|"))


def solve(rows: list[list[Fraction]]) -> list[list[Fraction]]:
    """Right-hand sides of the augmented matrix ``rows`` after exact elimination."""
    rows = [list(r) for r in rows]
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [r[n:] for r in rows]


def shapley_weights(n: int) -> list[list[Fraction]]:
    """For each of ``n`` players the weight of every coalition's value in the player's Shapley value.

    The values minimise sum over coalitions S of k(S) (v(S) - sum of S)^2 with the kernel
    k(S) = (n - 1) / (C(n, s) s (n - s)), under the constraint that they add up to v(all). The normal equations
    with a multiplier for the constraint are solved once for all right-hand sides: a solution is linear in v.
    """
    size = 1 << n
    kernel = [Fraction(0)] * size
    for s in range(1, size - 1):
        members = s.bit_count()
        kernel[s] = Fraction(n - 1, comb(n, members) * members * (n - members))
    rows = []
    for i in range(n):
        left = [sum((kernel[s] for s in range(size) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *(kernel[s] if s >> i & 1 else Fraction(0) for s in range(size))])
    whole = [Fraction(int(s == size - 1)) for s in range(size)]
    rows.append([Fraction(1)] * n + [Fraction(0)] + whole)
    return solve(rows)[:n]


def failures(texts: list[bytes], hasher: WordHasher) -> np.ndarray:
    """Bits of the filters A to D that each text fails: few words, few distinct words, capitals, signs."""
    words, ends = hasher.words(texts)
    n = np.diff(ends)
    by = np.lexsort((words, owner := np.repeat(np.arange(len(texts)), n)))
    new = np.ones(len(words), bool)
    new[1:] = (words[by][1:] != words[by][:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[new], minlength=len(texts))
    codes = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum([0, *map(len, texts)])
    inside = lambda hit: np.diff(np.concatenate(([0], np.cumsum(hit)))[stops])
    failed = [n < 100, 100 * distinct < 80 * n, 100 * inside(CAPITAL[codes]) > 10 * inside(codes & 0xC0 != 0x80), inside(SIGN[codes]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` (id, part, key, text) with ``mask`` instead of the text."""

    def judge(batches):
        hasher = WordHasher()
        for batch in row_blocks(batches, "text"):
            mask = pa.array(failures(bytes_of(batch, "text"), hasher), pa.int32())
            yield pa.record_batch([*(batch.column(c) for c in ("id", "part", "key")), mask], names=["id", "part", "key", "mask"])

    return docs.mapInArrow(judge, "id long, part string, key binary, mask int")


def outcomes(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail; at most 32 rows a part.

    Filter E fails all but the rows with the smallest doc_id of a text. A group of copies is never gathered: all of
    its rows are counted by part, its first rows are found by an aggregate that tasks reduce beforehand, and
    what is not first is the difference.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = staged(
        masked(
            docs.select(
                F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), "text"
            )
        )
        .groupBy("id", "part", "mask", "key").agg(F.count("*").alias("n")),
        "facts",
    )
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).groupBy("id").agg(
        F.coalesce(F.max("g"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic")
    )
    # the second key is 0 wherever an id can match; it deals rows without an id over all tasks
    salt = F.when(F.col("id").isNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long"))
    rows = facts.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    known = rows.select(
        "id", "part", "mask", "key", "n",
        F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0)).alias("toxic"),
    )
    known = staged(known, "labelled")
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    everything = known.groupBy("part", "mask").agg(*sums)
    # rows that share id and text (repeated rows, perhaps with other parts) stand together at the first place
    place = known.where("id IS NOT NULL").groupBy("key", "id").agg(
        F.first("mask").alias("mask"), F.collect_list(F.struct("part", "n", "good", "toxic")).alias("rows")
    )
    first = place.groupBy("key").agg(F.first("mask").alias("mask"), F.min_by("rows", "id").alias("rows"))
    originals = (
        first.select("mask", F.explode("rows").alias("row")).select("mask", "row.*")
        .unionByName(known.where("id IS NULL").select("mask", "part", "n", "good", "toxic"))
        .groupBy("part", "mask").agg(*sums)
    )
    minus = originals.select("part", (F.col("mask") + 16).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    repeated = everything.withColumn("mask", F.col("mask") + 16)
    return originals.unionByName(repeated).unionByName(minus).groupBy("part", "mask").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """What each of five filters removes at each place of each order of the filters, for each ``part`` of ``docs``.

    ``docs`` (doc_id, text, ``part``), ``labels`` (doc_id, quality, toxic). A document fails A with under 100 words,
    B with under 80 percent distinct words, C with more than 10 percent capitals A to Z, D with one of ``#$%&*|``, E if
    a row with a smaller doc_id has the same text. For each coalition of filters the documents that fail at least
    one member are tabulated (``removed`` of a step is the difference of two coalitions); the Shapley value, times
    the number of orders, is the solution of the kernel-weighted least squares under the efficiency constraint, in
    rationals. Both stay exact whole numbers.

    A null text is empty (fails A only, and E as a copy), a null part the empty string. A row without doc_id has no
    smaller one, is no copy's original and has no labels. Repeated rows of one doc_id are no copies of each other. A document is good or toxic if
    any of its labels says so. Without documents there are no rows. Other columns do not matter.
    """
    table = outcomes(docs, labels, part)
    measures = ("n", "good", "toxic")
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    coalitions = (
        table.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(COALITIONS - 1))))
        .groupBy("part", "coalition").agg(F.sum("n").alias("total"), *[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).alias(c) for c in measures])
    )
    removals = coalitions.groupBy("part").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("coalition", *measures))).alias("by"))
    removals = removals.select("part", "total", *[F.col(f"by.{c}").alias(c) for c in measures])
    orders, n = list(permutations(range(len(FILTERS)))), len(FILTERS)
    weights = [[w * len(orders) for w in row] for row in shapley_weights(n)]
    assert all(w.denominator == 1 for row in weights for w in row)
    value = lambda i: sum((F.lit(int(w)) * F.col("n")[s] for s, w in enumerate(weights[i]) if w), F.lit(0).cast("long"))
    removals = removals.withColumn("shapley", F.array(*[value(i) for i in range(n)]))
    steps = [
        ("".join(FILTERS[i] for i in order), k + 1, order[k], sum(1 << i for i in order[:k])) for order in orders for k in range(n)
    ]
    step = F.expr("array(" + ",".join(f"struct('{o}', {k}, {f}, {before}, {1 << f})" for o, k, f, before in steps) + ")")
    names = ("filter_order", "step", "filter", "before", "own")
    rows = removals.withColumn("at", F.explode(step)).select("*", *[F.col(f"at.col{i + 1}").alias(c) for i, c in enumerate(names)])
    before, own = F.col("before"), F.col("own")
    after = before.bitwiseOR(own)
    of = lambda c, s: F.get(F.col(c), s)
    removed = of("n", after) - of("n", before)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - of("n", after)).alias("kept"), removed.alias("removed"), (of("n", own) - removed).alias("redundant"),
        (of("n", F.lit(COALITIONS - 1)) - of("n", F.lit(COALITIONS - 1).bitwiseXOR(own))).alias("unique_fails"),
        (of("good", after) - of("good", before)).alias("good_lost"), (of("toxic", after) - of("toxic", before)).alias("toxic_lost"),
        of("shapley", F.col("filter")).alias("shapley"),
    )
